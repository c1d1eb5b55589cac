"""Operators on hand-made rows: nulls, empty arrays, ties and bounds."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import extract as E
from granary.functions import scores as S
from granary.functions import text as T
from granary.operators import analytics as A
from granary.operators import buckets as B
from granary.operators import filters as P
from granary.operators import graph as G
from granary.operators import learning as L
from granary.operators import linking as K
from granary.operators import normalize as N
from granary.operators import review as V
from granary.operators import search as Q


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_boolean_treats_null_as_false(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, x string")
    keep = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert keep(P.boolean(must_not=[F.col("x") == "a"])) == [2, 3]
    assert keep(P.boolean(should=[F.col("x") == "a", F.col("x") == "b"])) == [1, 3]
    assert keep(P.boolean()) == [1, 2, 3] and keep(P.nothing()) == [] and keep(P.everything()) == [1, 2, 3]


def test_array_predicates(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [("x", 1)]), (2, [], []), (3, None, None)], "id int, tags array<string>, people array<struct<name:string,n:int>>")
    keep = lambda c: [r.id for r in df.where(c).collect()]
    assert keep(P.is_value(df, "tags", "b")) == [1] and keep(P.is_value(df, "people.name", "x")) == [1]
    assert keep(P.in_values(df, "tags", "a")) == [1] and keep(P.present(df, "tags")) == [1]
    assert keep(~P.present(df, "tags")) == [2, 3] and keep(P.has_citations("tags", "people")) == [1]


def test_gates_and_dates(spark):
    assert P.date_bounds({"publishedAfter": 1, "date_from": 2, "publishedBefore": 3}) == (2, 3)
    r = one(spark, P.passes_gate(F.lit("video"), {"duration": F.lit(29)}).alias("a"), P.passes_gate(F.lit("video"), {"duration": F.lit(30)}).alias("b"), P.passes_gate(F.lit("article"), {"duration": F.lit(None)}).alias("c"))
    assert (r.a, r.b, r.c) == (False, True, True)


def test_terms_ties_and_multi_values(spark):
    df = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["b"]), (3, []), (4, None), (5, ["c", "a"])], "id int, tags array<string>")
    assert [tuple(r) for r in B.terms(df, "tags", 2).collect()] == [("a", 2), ("b", 2)]


def test_calendar_fills_gaps(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 5),), (dt.datetime(2020, 4, 1),), (None,)], "ts timestamp_ntz")
    assert [(r.bucket.month, r.doc_count) for r in B.calendar(df, "ts", "month").orderBy("bucket").collect()] == [(1, 1), (2, 0), (3, 0), (4, 1)]
    assert B.calendar(df.limit(0), "ts", "day").count() == 0


def test_ranges_leave_out_the_upper_bound(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.8,), (1.0,), (None,)], "v double")
    got = {r.key: r.doc_count for r in B.ranges(df, "v", [("low", 0.0, 0.5), ("medium", 0.5, 0.8), ("high", 0.8, 1.0)]).collect()}
    assert got == {"low": 1, "medium": 1, "high": 1}


def test_sketch_is_near_the_exact_count(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 5000)
    assert abs(B.cardinality(df, "k").first()[0] - B.cardinality(df, "k", exact=True).first()[0]) < 250


@pytest.mark.parametrize(("score", "tier"), [(1.0, "approved"), (0.7, "approved"), (0.69, "review_high"), (0.5, "review_high"), (0.3, "review_low"), (0.29, "rejected"), (None, "rejected")])
def test_routes(spark, score, tier):
    assert one(spark, S.route(F.lit(score).cast("double")).alias("t")).t == tier


def test_scores(spark):
    day = lambda n: F.lit(dt.datetime(2024, 1, 1) - dt.timedelta(days=n)).cast("timestamp_ntz")
    as_of = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    r = one(spark, S.recency(day(29), F.lit("video"), as_of).alias("a"), S.recency(day(29), F.lit("article"), as_of).alias("b"), S.recency(day(400), F.lit("documentation"), as_of).alias("c"), S.recency(F.lit(None).cast("timestamp_ntz"), F.lit("video"), as_of).alias("d"))
    assert (r.a, r.b, round(r.c, 6), r.d) == (1.0, 1.0, 0.48, 0.5)
    r = one(spark, S.priority(F.lit("high"), F.lit(1.0)).alias("a"), S.priority(F.lit("low"), F.lit(0.1)).alias("b"), S.has_role(F.lit("reviewer"), "contributor").alias("c"), S.has_role(F.lit("none"), "explorer").alias("d"))
    assert (r.a, r.b, r.c, r.d) == (10, 3, True, False)
    w = {"article": {"a": 0.5, "b": 0.5}}
    r = one(spark, S.weighted({"a": F.lit(1.0), "b": F.lit(0.5)}, F.lit("article"), w).alias("x"), S.weighted({"a": F.lit(1.0), "b": F.lit(1.0)}, F.lit("z"), w).alias("y"))
    assert (r.x, r.y) == (0.75, 0.5)
    assert one(spark, S.review_tier(F.lit(0.4), F.lit(False), 0.64, 0.45, 0.07).alias("t")).t == "review_high"


def test_gini_and_trend(spark):
    counts = spark.createDataFrame([(2001, "a", 1), (2001, "b", 2), (2001, "c", 3), (2002, "a", 9), (2003, "a", 5), (2003, "b", 5)], "year int, entity string, n long")
    got = {r.year: r.gini for r in A.concentration(counts).collect()}
    assert got == {2001: 0.222, 2003: 0.0}
    assert A.trend(A.concentration(counts)).first().trend == "insufficient_data"


def test_surges_skip_a_zero_year(spark):
    years = spark.createDataFrame([(2000, 0), (2001, 50), (2002, 65), (2003, 90)], "year int, n long")
    assert [r.year for r in A.surges(years).collect()] == [2003]


def test_cascade_takes_the_first_key_that_finds(spark):
    new = spark.createDataFrame([(1, "f1", "s1"), (2, None, "s2"), (3, "f9", "s9")], "id int, f string, s string")
    old = spark.createDataFrame([(10, "f1", "zz"), (11, "xx", "s1"), (12, "yy", "s2"), (9, "f1", "s0")], "id int, f string, s string")
    assert {r.id: r.duplicate_of for r in K.duplicate_cascade(new, old, [["f"], ["s"]]).collect()} == {1: 9, 2: 12, 3: None}


def test_similar_titles_match_brute_force(spark):
    import random

    rng = random.Random(3)
    titles = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 7)))) for k in range(60)]
    df = spark.createDataFrame(titles, "id int, t string")
    sets = {k: set(t.split()) for k, t in titles}
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    first = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets if sets[k]}
    rows = {r.id: r for r in K.similar_titles(df, "id", "t").collect()}
    assert {k: r.class_id for k, r in rows.items()} == first
    assert {k: r.links for k, r in rows.items()} == {k: sum(a == k for a, _ in want) for k in first}
    classes = K.title_classes(df, "id", "t").select("class_id", "tokens").distinct()
    assert {(r.a, r.b) for r in K.similar_classes(classes).collect()} == {(a, b) for a, b in want if a < b and first[a] == a and first[b] == b}


def test_rows_without_a_key_are_all_kept(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 3, "c"), ("k", 1, "d")], "k string, seq int, v string")
    assert sorted(r.v for r in K.first_seen(df, ["k"], ["seq"]).collect()) == ["a", "b", "d"]


def test_clusters_of_a_long_chain(spark):
    """Labels go on until none changes, whatever the diameter."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(150)] + [(500, 501), (600, 601), (601, 602)], "src long, dst long")
    got = sorted((r.cluster, r.size, r.central) for r in G.clusters(edges, 3).collect())
    assert got == [(0, 151, 1), (600, 3, 601)]


def test_percentiles_interpolate_over_ranges(spark):
    import numpy as np

    values = [float(k * k % 977) for k in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(7)
    got = {r.key: r.value for r in B.percentiles(df, "v").collect()}
    assert all(abs(got[f"p{p}"] - np.percentile(values, p)) < 1e-9 for p in B.PERCENTS)
    assert [r.value for r in B.percentiles(df.where("v < 0"), "v").collect()] == [None] * len(B.PERCENTS)


def test_shared_identifiers_prefer_pmids(spark):
    df = spark.createDataFrame([(1, "PMID: 123 see 10.1234/ab"), (2, "pmid 123, 10.1234/ab"), (3, "10.1234/ab"), (4, None)], "id int, t string")
    rows = K.shared_identifiers(df.withColumn("i", T.identifiers([F.col("t")])), "id", "i").where("left_id < right_id").collect()
    assert {(r.left_id, r.right_id, r.kind) for r in rows} == {(1, 2, "pmid"), (1, 3, "doi"), (2, 3, "doi")}


def test_a_crowded_identifier_makes_no_pairs(spark):
    n = 20000
    texts = [(i, f"PMID: {1000 + i}" if i % 3 else "PMID: 999 and PMID: 999, 10.1234/x") for i in range(n)] + [(n, None), (n + 1, "")]
    rows = K.identifier_links(spark.createDataFrame(texts, "id int, t string").select("id", T.identifiers([F.col("t")]).alias("i")), "id", "i").collect()
    hot = (n + 2) // 3
    assert len(rows) == 2 * hot and {(r.class_id, r.links) for r in rows} == {(0, hot - 1)} and {r.kind for r in rows} == {"pmid", "doi"}


def test_merge_duplicates(spark):
    rows = [("k", 1, 0.1, "aa", ["x"], 3), ("k", 2, 0.9, "bbb", ["y", "x"], None)]
    df = spark.createDataFrame(rows, "k string, seq int, score double, body string, cats array<string>, views int")
    r = K.merge_duplicates(df, "k", "seq", ["score"], ["body"], ["cats"], ["views"], ["seq"]).first()
    assert (r.merged, r.score, r.body, r.cats, r.views, r.seq) == (2, 0.9, "bbb", ["x", "y"], 3, 1)


def test_review_actions(spark):
    queue = spark.createDataFrame([("a", "pending", 0.5, 0.7, None), ("b", "pending", 0.1, 0.1, None), ("c", "pending", 0.2, 0.2, None)], "id string, status string, ml_score double, ai_confidence double, reviewer_id string")
    queue = queue.withColumn("reviewed_date", F.lit(None).cast("timestamp_ntz")).withColumn("categories", F.array(F.lit("old")))
    actions = spark.createDataFrame([("a", "approve", "r", ["new"]), ("b", "reject", "r", None), ("zz", "approve", "r", None)], "id string, action string, reviewer string, categories array<string>")
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    assert {r.id: r.status for r in V.review(queue, actions, now).collect()} == {"a": "approved", "b": "rejected", "c": "pending"}
    got = V.approve(queue, actions, now).collect()
    assert len(got) == 1 and got[0].final_score == 0.6 and got[0].categories == ["new"] and got[0].view_count == 0 and "status" not in got[0].asDict()
    assert {r.id: r.outcome for r in V.outcomes(actions, queue).collect()} == {"a": "success", "b": "success", "zz": "failed"}


def test_patch_and_swap(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id int, x string, n int")
    changes = spark.createDataFrame([(1, None, 5), (3, "z", 9)], "id int, x string, n int")
    assert sorted(tuple(r) for r in V.patch(table, changes, ["x", "n"]).collect()) == [(1, "a", 5), (2, "b", None)]
    assert V.swap(spark, table, str(tmp_path), "v1", "current") == 2 and spark.table("current").count() == 2


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abc")), max_size=8, unique_by=lambda t: t[0]), st.lists(st.tuples(st.integers(0, 5), st.sampled_from("xyz")), max_size=8, unique_by=lambda t: t[0]))
def test_upsert_is_idempotent(spark, old, new):
    schema = "id int, v string"
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    once = V.upsert(a, b)
    assert sorted(once.collect()) == sorted(V.upsert(once, b).collect())
    assert {r.id: r.v for r in once.collect()} == dict(old) | dict(new)


def test_normalisers(spark):
    art = spark.createDataFrame([("PMID12", "T", "A", ["Roe, Ann"], ["1", "2"], ["3"])], "pmid string, title string, abstract string, authors array<string>, cited_by array<string>, references array<string>")
    vid = spark.createDataFrame([("v", "T", "D", None)], "video_id string, title string, description string, transcript string")
    out = {r.id: r for r in N.normalise({"article": art, "video": vid}).collect()}
    assert out["12"].authors == ["Ann Roe"] and out["12"].citations.cited_by_count == 2 and out["12"].metrics.citation_count == 2
    assert out["v"].content == "D" and out["v"].approval_status == "pending" and out["v"].content_type == "video"
    with pytest.raises(ValueError, match="unknown kinds"):
        N.normalise({"song": art})


def test_text_functions(spark):
    r = one(
        spark,
        T.normalised(F.lit(" Ärger--über  x_1! ")).alias("a"),
        T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>")).alias("b"),
        T.clean(F.lit("<p>a &amp; b</p>\nc")).alias("c"),
        T.questions(F.lit("No. Is this one long enough? Hm?")).alias("d"),
        T.fingerprint(F.lit("s"), F.lit("1"), F.lit("T"), F.lit(None), F.lit(None), ["s"]).alias("e"),
        T.mentions(F.lit("R-code and atlas."), ["atlas", "cod"]).alias("f"),
        E.duration_seconds(F.lit("PT1H2M3S")).alias("g"),
        E.duration_seconds(F.lit("1h")).alias("h"),
        E.duration_label(F.lit(3720)).alias("i"),
        E.loose_date(F.lit("2020 Mar")).alias("j"),
        E.loose_date(F.lit("soon")).alias("k"),
        E.organisation(F.lit("Uni of X USA, Dept, me@x.org")).alias("m"),
        E.year_of(F.lit("in 1987 or 2001")).alias("n"),
    )
    import hashlib

    assert (r.a, r.b, r.c) == ("ärger über x_1", 0.0, "a & b c")
    assert r.d == ["Is this one long enough?"] and r.e == hashlib.md5(b"s|1").hexdigest() and r.f == ["atlas"]
    assert (r.g, r.h, r.i, r.j, r.k, r.m, r.n) == (3723, None, "1h 2m", dt.date(2020, 3, 1), None, "Uni of X", 1987)


def test_readme_and_threads(spark):
    text = "# Tool\n\npip install tool\n\n- fast\n- small\n\n```\ncode\n```\n[docs](http://d) ![b](http://badge)\n\nMIT License"
    f = one(spark, E.readme_facts(F.lit(text)).alias("f")).f
    assert f.sections == ["Tool"] and f.method == "pip" and f.features == ["fast", "small"] and f.license == "MIT" and f.links == ["http://d"] and f.badges == ["http://badge"] and f.code_blocks == 1
    facts = E.thread_facts(F.lit("How do I?"), F.lit(""), F.array(F.lit("<code>x</code>"), F.lit("This solved it")), F.lit(None).cast("boolean"), [], [])
    assert one(spark, E.thread_type(facts).alias("t")).t == "solved_question"


def test_search_orders_by_relevance(spark):
    docs = spark.createDataFrame([(1, "apple pie apple"), (2, "apple tart with many other words in it"), (3, "pear"), (4, None)], "id int, t string")
    got = Q.page(Q.bm25(docs, "id", "t", ["apple"])).collect()
    assert [r.id for r in got] == [1, 2] and Q.bm25(docs, "id", "t", []).count() == 0
    words = spark.createDataFrame([("apple",), ("aple",), ("pear",)], "term string")
    assert {r.term for r in Q.fuzzy_terms(words, "apple").collect()} == {"apple", "aple"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id int, v array<double>")
    near = Q.neighbours(v, v.where("id = 1"), "id", "v").collect()
    assert [(r.query, r.id, r.rank) for r in near] == [(1, 2, 1)]
    assert {r.id for r in Q.semantic(v, "id", "v", [1.0, 0.0]).collect()} == {1, 2, 3}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "src long, dst long")
    assert {(r.cluster, r.size, r.central) for r in G.clusters(e).collect()} == {(1, 4, 3)}
    assert sorted(r.path for r in G.paths(e, 1, 4).collect()) == [[1, 2, 3, 4]]
    assert {r.node: r.triangles for r in G.triangles(e).collect()} == {1: 1, 2: 1, 3: 1}
    d = G.density(e, spark.createDataFrame([(1,), (2,), (3,)], "node long")).first()
    assert (d.nodes, d.edges, d.density, d.avg_degree) == (3, 3, 1.0, 2.0)


def test_learning(spark):
    df = spark.createDataFrame([("deep net model", 1), ("deep learning", 1), ("cooking net", 0), (None, 0)], "t string, y int")
    stats = {r.term: (r.pos, r.neg) for r in L.term_statistics(df, "t", "y", most=2, least_docs=1).collect()}
    assert stats["deep"] == (2, 0) and stats["net"] == (1, 1) and stats["deep net"] == (1, 0)
    assert L.without_parts([("deep net", 0.5), ("net", 0.4), ("cook", 0.3)]) == ["deep net", "cook"]
    got = L.greedy_cover(df.where("t is not null"), "t", [[["net"]], [["deep"]], [["cooking"]]], 1.0)
    assert [(q, n) for q, n, _ in got] == [(0, 2), (1, 1)] and got[-1][2] == 1.0
    c = L.confusion(spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0)], "y int, p int"), F.col("y"), F.col("p")).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.f1) == (1, 1, 1, 1, 0.5)


def test_forest_and_calibration(spark):
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 7 >= 4).cast("double").alias("y"))
    scored = L.out_of_fold(rows, "id", ["a"], "y", folds=3, trees=5, depth=3)
    assert scored.count() == 300
    fitted = L.calibrator(scored, "y").transform(scored)
    assert fitted.where("calibrated < 0 or calibrated > 1").count() == 0
    assert fitted.where((F.col("calibrated") >= 0.5) != (F.col("y") == 1)).count() == 0


def test_citation_stats(spark):
    papers = spark.createDataFrame([(1, 2020, ["a"]), (2, 2023, ["a", None]), (3, 2024, [None]), (4, None, None)], "node int, year int, authors array<string>")
    edges = spark.createDataFrame([(2, 1), (2, 1), (3, 1), (9, 1), (1, 1), (3, 2), (1, 4)], "src int, dst int")
    got = {r.node: tuple(r)[1:] for r in G.citation_stats(edges, papers, 2024).collect()}
    assert got == {1: (4, 3, 1, 0.75, 2, 1), 2: (1, 1, 1, 1.0, 1, 0), 3: (0, 0, 2, 0.0, 0, 0), 4: (None, 1, 0, 1.0, 0, 0)}


def test_trends_and_ranges(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [(t, now - dt.timedelta(days=d)) for t, days in {"up": [0, 1, 12], "down": [11, 12, 3], "same": [0, 10], "new": [9], "old": [20, 21], None: [1]}.items() for d in days]
    df = spark.createDataFrame(rows, "t string, ts timestamp")
    got = {r.t: (r.n, r.before, r.trend) for r in A.trends(df, "t", "ts", F.lit(now), 10).collect()}
    assert got == {"up": (2, 1, "up"), "down": (1, 2, "down"), "same": (1, 1, "stable"), "new": (1, 0, "up")}
    scores = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 1.0, 1.1, -0.1, None)], "s double")
    assert {r.range: (r.n, r.percentage) for r in A.range_shares(scores, "s", [0, 0.25, 0.5, 1]).collect()} == {"0-0.25": (1, 25.0), "0.25-0.5": (0, 0.0), "0.5-1": (3, 75.0)}
    assert {r.percentage for r in A.range_shares(scores.limit(0), "s", [0, 0.5, 1]).collect()} == {0.0}
