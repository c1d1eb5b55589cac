"""Steps whose cost grew faster than their rows, and results at values that only larger tables have."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import extract as E
from granary.operators import buckets as B
from granary.operators import learning as L
from granary.operators import linking as K
from granary.operators import query_learning as Q


def _long_text(spark, n, at):
    """One text of n different words, with a title from word `at` on."""
    words = [f"w{i}" for i in range(n)]
    title = " ".join(words[at : at + 5])
    return spark.createDataFrame([(1, " ".join(words))], "id long, text string"), spark.createDataFrame([(7, title), (8, title + " other"), (9, "w1 w2")], "tid long, title string")


def test_titles_in_a_long_text_cost_its_length_once(spark):
    texts, titles = _long_text(spark, 40_000, 39_000)
    start = time.monotonic()
    assert [tuple(r) for r in K.named_in(texts, "id", "text", titles, "tid", "title").collect()] == [(1, 7)]
    assert time.monotonic() - start < 40  # splitting the text anew for each of its words takes minutes


def test_titles_at_the_ends_of_texts(spark):
    texts = spark.createDataFrame([(1, "A b, c!"), (2, "x a B c"), (3, "a b"), (4, ""), (5, None), (6, "a b cd")], "id long, text string")
    titles = spark.createDataFrame([(7, "a b c"), (8, "b c"), (9, None)], "tid long, title string")
    assert sorted(tuple(r) for r in K.named_in(texts, "id", "text", titles, "tid", "title").collect()) == [(1, 7), (2, 7)]


def test_bucket_keys_of_late_years(spark):
    rows = [(10**12,), (10**12 + 1,), (253402300799999,), (253402300800000,), (999990000000000,), (60_000_000_000_000_000,), (2**31 * 86400000 - 1000,), (2**31 * 86400000,), (None,)]
    got = [r.k for r in spark.createDataFrame(rows, "v long").select(B.bucket_key(F.col("v")).alias("k")).collect()]
    assert got == ["1000000000000", "2001-09-09", "9999-12-31", "10000-01-01", "33658-06-03", "1903294-04-23", "5881580-07-11", "185542587187200000", None]


def test_a_question_word_ends_before_an_accent(spark):
    titles = [("Do\u00f3 ci\u00f3nado",), ("do it",), ("dough",), ("do_it",), ("do",), ("is\u4e2d",), ("redo it",)]
    facts = E.thread_facts(F.col("t"), F.lit(""), F.array().cast("array<string>"), F.lit(False), [], [])
    assert [r.q for r in spark.createDataFrame(titles, "t string").select(facts["is_question"].alias("q")).collect()] == [True, True, False, False, True, True, False]


def test_candidates_of_titles_are_rows_of_numbers(spark):
    from granary.operators import titles

    many = " ".join(f"w{i}" for i in range(3000))
    new = spark.createDataFrame([(1, "w1 w2 rare"), (2, many + " more"), (3, "w7")], "id long, title string")
    known = spark.createDataFrame([(10, many), (11, "w1 w2 rare thing"), (12, "w7"), (13, "w7 w8")], "id long, title string")
    ours, theirs = titles._classes(new, "id", "title"), titles._classes(known, "id", "title")
    found = titles.candidates(ours, theirs)
    assert found.dtypes == [("ours", "bigint"), ("theirs", "bigint"), ("score", "double")]  # the titles themselves are not sent with each pair
    named = found.join(ours.select(F.col("number").alias("ours"), "id"), "ours").join(theirs.select(F.col("number").alias("theirs"), F.col("id").alias("other")), "theirs")
    assert sorted((r.id, r.other) for r in named.collect()) == [(1, 10), (1, 11), (2, 10), (3, 10), (3, 12), (3, 13)]


def test_titles_that_share_a_common_word_are_not_sent_as_pairs(spark, monkeypatch):
    from granary.operators import titles

    new = spark.range(400).select("id", F.concat(F.lit("of the "), F.lit("common thing n"), "id").alias("title"))
    known = spark.range(300).select("id", F.concat(F.lit("in of the common thing m"), "id").alias("title")).unionByName(spark.range(1000, 1003).select("id", F.concat(F.lit("the common thing of n"), F.col("id") - 1000).alias("title")))
    ours, theirs = titles._classes(new, "id", "title"), titles._classes(known, "id", "title")
    whole = {(r.ours, r.theirs): r.score for r in titles.candidates(ours, theirs).collect()}
    assert len(whole) == 400 * 303
    for name, size in (("BLOCK", 2000), ("PART", 4000), ("AT_ONCE", 500)):  # several blocks, and pieces smaller than a title's pairs
        monkeypatch.setattr(titles, name, size)
    cells = titles.compared(ours, theirs, most=10)
    assert cells.count() <= 400 * 10 * 5  # before: all of the 121,200 pairs that share a word
    best = {}
    for r in cells.collect():
        best.setdefault(r.ours, []).append((-r.score, r.theirs))
    for k, found in best.items():
        assert sorted(found)[:10] == sorted((-s, t) for (o, t), s in whole.items() if o == k)[:10]
    got = {r.id: r.duplicate_of for r in titles.near_titles(new, known, "id", "title", least=0.5).collect()}
    assert got[0] == 1000 and got[2] == 1002 and all(v is not None for v in got.values())


def test_pairs_of_groups_are_dealt_by_their_number(spark, monkeypatch):
    from granary.operators import graph as G

    monkeypatch.setattr(G, "TASK_PAIRS", 100)
    rows = spark.range(3).crossJoin(spark.range(50).withColumnRenamed("id", "m")).withColumnRenamed("id", "g")
    pairs = G.together(rows, "g", "m", 2)
    assert pairs.rdd.getNumPartitions() == 3 * (50 * 49 // 2) // 100 + 1  # before: as many as the session has, however many pairs
    assert pairs.count() == 50 * 49 // 2 and pairs.agg(F.min("weight"), F.max("weight")).first() == (3, 3)
    assert G.together(rows.limit(0), "g", "m", 2).count() == 0


def test_terms_are_counted_in_their_own_row(spark, tmp_path):
    from granary.operators import search as S

    rows = spark.createDataFrame([(1, ["a", "b", "b", "c"]), (2, []), (3, ["z"]), (4, ["q", "q", "q"])], "id int, t array<string>")
    got = {r.id: r.c and [tuple(c) for c in r.c] for r in rows.select("id", S._counts(F.col("t")).alias("c")).collect()}
    assert got == {1: [("a", 1), ("b", 2), ("c", 1)], 2: None, 3: [("z", 1)], 4: [("q", 3)]}
    docs = spark.createDataFrame([(i, "the The other" if i % 2 else None) for i in range(400)], "id long, text string").repartition(64)
    S.write_index(docs, "id", {"text": F.col("text")}, str(tmp_path / "index"))
    index = S.read_index(spark, str(tmp_path / "index"))
    assert index.numbers == {"text": (400, 1.5)}
    assert {tuple(r) for r in index.postings.groupBy("term").agg(F.count("id"), F.min("tf"), F.max("len")).collect()} == {("the", 200, 2, 3), ("other", 200, 1, 3)}
    assert index.postings.where("term = 'the'").select(F.input_file_name()).distinct().count() > 1


def test_pairs_that_share_identifiers_are_not_shuffled(spark):
    ids = "struct<pmids:array<string>,dois:array<string>,urls:array<string>>"
    rows = spark.createDataFrame([(1, (["5", "6"], ["d"], [])), (2, (["6", "5"], ["d"], ["u"])), (3, ([], ["d"], ["u", "u"])), (4, (["9"], [], [])), (4, (["9"], ["x"], []))], f"id long, i {ids}")
    found = K.shared_identifiers(rows, "id", "i")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "pmid"), (1, 3, "doi"), (2, 1, "pmid"), (2, 3, "doi"), (3, 1, "doi"), (3, 2, "doi")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # nothing is grouped above the join that makes the pairs


def test_flags_search_plain_words_without_regular_expressions(spark):
    from granary.functions import quality as Q

    texts = ["an EXAMPLE", "stepXby step", "step\rby\u2028step", "step\nby step", "how to", "howto", "how\nto how-to", "step by", "", None, "faq glossary error api guide install manual"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    flags = rows.select("i", "t", Q.indicators(F.col("t")).alias("f"), Q.transcript_quality(F.col("t"), F.lit(3)).alias("q"))
    want = [{n: bool(re.search(p.replace(".", "[^\n]"), (t or "").lower())) for n, p in Q.INDICATORS.items()} for t in texts]
    assert [r.f.asDict() for r in flags.orderBy("i").collect()] == want  # before: other line ends than \\n stopped the dot, unlike SQL's
    plan = flags._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 3 and plan.count("split(") == 1  # before: one for each flag, and the words counted anew for each step of the score


def test_subsumed_terms_need_no_python_and_no_large_group(spark):
    from granary.operators import query_learning as Q

    rows = [("a", 5), ("a b", 5), ("b", 6), ("ab", 7), ("zz", 1), ("a b c", 4), ("ét", 2), ("été", 2), ("", 9), ("w" * 3000, 3), ("w" * 2999, 3), ("w" * 2998, 9)]
    found = Q.without_subsumed(spark.createDataFrame(rows, "term string, score long"))
    assert sorted(r.term for r in found.collect()) == sorted(kept_by_rule(dict(rows)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # before: an automaton of 200,000 terms in each Python worker, and each term met every automaton
    assert Q.without_subsumed(spark.createDataFrame([("", 1)], "term string, score long")).count() == 0


def kept_by_rule(scores):
    kept = []
    for t in sorted((t for t in scores if t), key=lambda t: (-scores[t], t)):
        if not any(t in k for k in kept):
            kept.append(t)
    return kept


def _plain_grams(text, most, words=None):
    t = [w if words is None or w in words else None for w in re.findall(r"[^\W]+", (text or "").lower())]
    return list(dict.fromkeys(" ".join(t[i : i + n]) for n in range(1, most + 1) for i in range(len(t) - n + 1) if None not in t[i : i + n]))


def test_grams_of_given_words(spark):
    texts = ["a b c a b c", "a", "a b", "", None, "x", "a x b", "Été, a_1! b a b", "x a b x b c x", "c b a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (1, 2, 3, 4):
        for words in (None, ["a", "b", "c"], []):
            got = [r.g for r in rows.select("i", L.grams(F.col("t"), most, words).alias("g")).orderBy("i").collect()]
            assert got == [_plain_grams(t, most, words) for t in texts]


@pytest.mark.parametrize("literals", [8192, 5])
def test_best_terms_without_all_runs_of_words(spark, monkeypatch, literals):
    monkeypatch.setattr(L, "LITERALS", literals)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(" ".join(rng.choices(vocabulary[: 12 + 28 * (i % 2)], [1 / (k + 1) for k in range(12 + 28 * (i % 2))], k=rng.randint(0, 30))), 1 - i % 2) for i in range(300)] + [(None, 1), (None, None)]
    rows = spark.createDataFrame(docs, "t string, y int")
    words = L.term_statistics(rows, "t", "y")
    for most, shortest in ((1, 1), (8, 1), (20, 3), (25, 4), (30, 6), (5000, 1)):
        every = L.term_statistics(rows, "t", "y", most=3).where(F.length("term") >= shortest)
        assert Q.best_terms(rows, "t", "y", words, most, shortest=shortest) == Q.top_terms(every, most)


def test_gap_terms_are_those_of_all_runs(spark, monkeypatch):
    rng = random.Random(8)
    a, b = (spark.createDataFrame([(k + i, " ".join(rng.choices([f"w{j}" for j in range(30)], range(m, m + 30), k=25))) for i in range(60)], "k long, t string") for k, m in ((0, 1), (100, 90)))
    got = Q.gap_candidates(a, b, "k", "t")
    monkeypatch.setattr(Q, "covering_words", lambda *_: None)
    assert got == Q.gap_candidates(a, b, "k", "t") and len(got) > 2


def test_learned_queries_make_no_runs_of_rare_words(spark, monkeypatch):
    from granary.plans.learned import learned_queries

    made, grams = [], L.grams
    monkeypatch.setattr(L, "grams", lambda text, most=3, *words: made.append((most, *(words or [None]))) or grams(text, most, *words))
    rows = learned_queries(spark, "/root/testdata/sf0.001").collect()
    assert rows and [w for most, w in made if most > 1 and w is None] == []  # before: all runs of up to three words, of all labelled texts three times and of the gap once
    assert sum(most > 1 for most, _ in made) <= 2
    monkeypatch.setattr(L, "LITERALS", -1)
    assert learned_queries(spark, "/root/testdata/sf0.001").collect() == rows


def test_labelled_texts_are_not_sent_to_be_joined(spark, monkeypatch):
    from granary.plans import learned

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16")  # as if the labels were many
    try:
        plans = {}
        for most in (learned.BROADCAST_LABELS, 0):
            monkeypatch.setattr(learned, "BROADCAST_LABELS", most)
            d = learned._labelled(spark, "/root/testdata/sf0.001")
            plans[most] = (sorted(map(tuple, d.collect())), d._jdf.queryExecution().sparkPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (few, sent), (many, dealt) = plans.values()
    assert few == many and few
    assert "BroadcastHashJoin" in sent and "SortMergeJoin" not in sent  # before: all documents were dealt by id, once for each step
    assert "SortMergeJoin" in dealt
