"""Title ratios, explained predictions and learned queries against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from granary.operators import explain, titles
from granary.operators import learning as L
from granary.operators import query_learning as Q

WORDS = "deep net graph model study data cohort care health record claims risk score drug trial".split()


def _title(rng):
    return " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))


def test_near_titles_by_brute_force(spark):
    rng = random.Random(3)
    known = [(i, _title(rng)) for i in range(300)] + [(900, None), (901, ""), (902, "Deep Net!"), (903, "x" * 300)]
    new = [(1000 + i, _title(rng) if i % 3 else known[i][1] + rng.choice(["", "s", " x", "?"])) for i in range(120)] + [(2000, None), (2001, " -- "), (2002, "x" * 299 + "y")]
    got = {r.id: (r.duplicate_of, r.ratio) for r in titles.near_titles(*(spark.createDataFrame(x, "id long, title string, score int, name string") for x in ([(*r, 1, "c") for r in new], [(*r, 1, "c") for r in known])), "id", "title").collect()}
    assert len(got) == len(new)
    plain = lambda t: " ".join("".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split())
    classes = {}
    for i, t in known:
        if plain(t):
            classes[plain(t)] = min(i, classes.get(plain(t), i))
    df = Counter(w for c in classes for w in set(c.split()))
    usual = sum(len(c.split()) for c in classes) / len(classes)
    import math

    found = 0
    for i, t in new:
        asked = set(plain(t).split())
        scores = []
        for c in classes:
            words = c.split()
            shared = asked & set(words)
            if asked and len(shared) >= max(1, math.floor(0.8 * len(asked) + 1e-9)):
                s = sum(math.log(1 + (len(classes) - df[w] + 0.5) / (df[w] + 0.5)) * (tf := words.count(w)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / usual)) for w in shared)
                scores.append((-round(s, 6), c))
        want = next(((classes[c], r) for _, c in sorted(scores)[:10] if (r := SequenceMatcher(None, plain(t), c).ratio()) >= 0.85), (None, None))
        assert got[i][0] == want[0] and (want[1] is None or abs(got[i][1] - want[1]) < 1e-9), (t, got[i], want)
        found += want[0] is not None
    assert found > 30


def test_ratio_bounds_agree_with_the_ratio():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(0, 12))) for _ in range(2))
        r = SequenceMatcher(None, a, b).ratio()
        assert titles.ratio_at_least(a, b, 0.5) == (r if r >= 0.5 else None)


def test_contributions_add_up(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random(), rng.random(), 0) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, c, int(a + 0.3 * b > 0.7)) for i, a, b, c, _ in rows], "id long, a double, b double, tfidf_c double, y int")
    names = ["a", "b", "tfidf_c"]
    fitted = L.forest(df, names, "y", trees=7, depth=4)
    forest = fitted.stages[-1]
    out = explain.contributions(df.select("id", F.array(*names).alias("x")), "id", "x", names, explain.node_table(forest, spark), top=2)
    from pyspark.ml.functions import vector_to_array

    want = {r.id: r.p for r in fitted.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = out.collect()
    assert len(got) == 400
    for r in got:
        assert abs(r.probability - want[r.id]) < 1e-9 and abs(r.total - r.probability) < 1e-9
        assert [f.feature for f in r.factors] == [f.feature for f in sorted(r.factors, key=lambda f: -abs(f.contribution))]
        assert len(r.factors) == 2 and all(not f.feature.startswith("tfidf_") for f in r.factors)
    assert Counter(r.factors[0].feature for r in got).most_common(1)[0][0] == "a"


def test_default_categories(spark):
    df = spark.createDataFrame([(0.95,), (0.85,), (0.75,), (0.1,)], "p double")
    rows = df.select(explain.default_categories(F.col("p"), [(0.9, ["m", "d"]), (0.8, ["m"]), (0.7, ["c"])]).alias("c")).collect()
    assert [r.c for r in rows] == [["m", "d"], ["m"], ["c"], []]


@pytest.mark.parametrize("block", [200_000, 700])
def test_subsumed_terms_by_the_greedy_rule(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = random.Random(7)
    terms = {" ".join(rng.choices(WORDS + [w[:4] for w in WORDS], k=rng.randint(1, 3))): rng.randint(1, 60) for _ in range(9000)}
    terms = dict(list(terms.items())[:5000])
    kept = []
    for t in sorted(terms, key=lambda t: (-terms[t], t)):
        if not any(t in k for k in kept):
            kept.append(t)
    got = Q.without_subsumed(spark.createDataFrame(list(terms.items()), "term string, score long"))
    assert sorted(r.term for r in got.collect()) == sorted(kept)


def _docs(rng, n):
    return [(i, " ".join(rng.choices(WORDS[: 6 + i % 10], k=12))) for i in range(n)]


def test_contexts_by_brute_force(spark):
    docs = _docs(random.Random(2), 150)
    terms = [Q.Term(w, 0.1 + 0.01 * i, 0.5 + 0.02 * i) for i, w in enumerate([*WORDS, "data co", "net graph", "zz"])]
    found = Q.occurrences(spark.createDataFrame(docs, "k long, t string"), "k", F.col("t"), [t.term for t in terms])
    got = {r.term: list(r.contexts) for r in Q.context_terms(found, terms, stop=["study"]).collect() if r.contexts}
    want = {}
    for t in terms:
        rows = [x for _, x in docs if t.term in x]
        scored = []
        for c in terms:
            both = sum(c.term in x for x in rows)
            if len(rows) >= 3 and c.term not in t.term and t.term not in c.term and c.term != "study" and len(c.term) > 2 and both / len(rows) >= 0.3:
                scored.append((-round(both / len(rows) * (c.coverage * c.specificity), 12), terms.index(c), c.term))
        picked = []
        for *_, c in sorted(scored):
            if len(picked) < 3 and not any(c in p or p in c for p in picked):
                picked.append(c)
        if picked:
            want[t.term] = picked
    assert got == want and len(want) > 10


def test_cover_of_many_candidates(spark):
    rng = random.Random(11)
    docs = [(i, "".join(chr(97 + rng.randint(0, 25)) for _ in range(3))) for i in range(300)] + [(999, None)]
    queries = [Q.Candidate(a + b, "x", ((a, b),)) for a in "abcdefghij" for b in "klmnopqrst"]
    assert len(queries) > 60
    rounds = Q.cover(Q.matches(spark.createDataFrame(docs, "k long, t string"), "k", "t", queries), 0.9, 15)
    sets = [{i for i, t in docs if t and any(x in t for x in q.groups[0])} for q in queries]
    covered, want = set(), []
    while len(want) < 15 and len(covered) < 0.9 * len(docs):
        best = max(range(len(sets)), key=lambda q: (len(sets[q] - covered), -q))
        if not sets[best] - covered:
            break
        want.append((best, len(sets[best]), len(sets[best] - covered), len(covered | sets[best])))
        covered |= sets[best]
    assert [(r["query"], r["total_matches"], r["new_matches"], r["covered"]) for r in rounds] == want


def test_candidates_of_all_strategies(spark):
    rng = random.Random(4)
    good = [(i, "cohort study of health records with claims data" if i % 2 else "network of hospital registry sites and drug exposure") for i in range(40)]
    bad = [(100 + i, " ".join(rng.choices(["cat", "dog", "bird"], k=6))) for i in range(40)]
    a, b = (spark.createDataFrame(x, "k long, t string") for x in (good, bad))
    phrases = [Q.Term("health records", 0.5, 1.0), Q.Term("claims data", 0.5, 1.0), Q.Term("records with claims", 0.5, 0.9), Q.Term("study", 0.5, 0.9)]
    out = Q.candidates(a, b, "k", "t", [Q.Term("cohort", 0.5, 1.0)], phrases, subjects=[Q.Term("drug", 0.5, 0.9)])
    kinds = Counter(q.strategy for q in out)
    assert kinds["brand"] == 1 and kinds["phrase_context"] >= 3 and kinds["subject"] == 1 and kinds["combined"] >= 1 and kinds["gap_recovery"] > 0
    rounds = Q.cover(Q.matches(a, "k", "t", out))
    assert rounds[-1]["recall"] >= 0.9 and all(x["recall"] < y["recall"] for x, y in zip(rounds, rounds[1:], strict=False))
    assert Q.Candidate("n", "s", (("a b", "c"), ("d",))).query == '("a b" OR "c") AND "d"'
    assert Q.gap_candidates(a.limit(9), b, "k", "t") == []


def test_keys_of_people(spark):
    df = spark.createDataFrame([("Doe", "JK", None), (None, None, "Roe, Mary"), ("", "", "Poe"), ("Lee", None, None)], "l string, i string, n string")
    assert [r[0] for r in df.select(Q.author_key(F.col("l"), F.col("i"), F.col("n"))).collect()] == ["doe j", "roe m", None, "lee "]


def test_spread_and_merge_of_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else None, float(rng.randint(0, 500)), i, [f"v{rng.randint(0, 40)}" for _ in range(3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, i long, a array<string>")
    got = {r.g: (r.least, r.median, r.most) for r in L.score_spread(df, "g", "s").collect()}
    for g in ("hot", None):
        s = sorted(r[1] for r in rows if r[0] == g)
        assert got[g] == (s[0], s[len(s) // 2], s[-1])
    from granary.operators.linking import merge_duplicates

    merged = {r.g: r.a for r in merge_duplicates(df, "g", "i", united=["a"]).collect()}
    assert merged == {g: sorted({v for r in rows if r[0] == g for v in r[3]}) for g in ("hot", None)}
