"""Summaries, outlines and trails against plain Python."""

import random
import re

from pyspark.sql import functions as F

from granary.functions import outline as O


def test_summary_cuts_at_the_first_overflow(spark):
    rng = random.Random(1)
    texts = [None, "", "short.", "x" * 700] + [" ".join("the key model of data".split()[rng.randint(0, 4)] + rng.choice(["", "", ".", "!?"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(O.summary(F.col("t"), ["model", "data"])).collect()]
    for t, mine in zip(texts, got, strict=True):
        scored = []
        for s in re.split(r"[.!?]+", t or ""):
            if len(s) >= 20:
                scored.append((s, sum(2 for w in ("model", "data") if w in s.lower()) + sum(1 for m in O.MARKERS if m in s.lower())))
        scored.sort(key=lambda x: -x[1])
        kept, size = [], 0
        for s, _ in scored:
            if size + len(s) > 500:
                break
            kept.append(s.strip())
            size += len(s)
        assert mine == (". ".join(kept) + "." if kept else (t or "")[:500])


def test_outline_of_nested_headings(spark):
    rows = [("p", i, level, name) for i, (level, name) in enumerate([(2, "lost"), (1, "A"), (3, "A.x"), (2, "B"), (3, "C"), (2, "D"), (1, "E"), (3, "F")])] + [("q", 0, 1, "only")]
    out = {r.title: (r.parent, list(r.path), r.until) for r in O.outline(spark.createDataFrame(rows, "doc string, at long, level int, title string"), "doc", "at", "level", "title").collect()}
    assert out == {"lost": (None, ["lost"], 1), "A": (None, ["A"], 6), "A.x": ("A", ["A", "A.x"], 3), "B": ("A", ["A", "B"], 5), "C": ("B", ["A", "B", "C"], 5), "D": ("A", ["A", "D"], 6), "E": (None, ["E"], None), "F": ("E", ["E", "F"], None), "only": (None, ["only"], None)}


def test_sections_between_headings(spark):
    rows = [(1, i, x) for i, x in enumerate(["before", "# A", "a1", "a2", "# B", "# C", "c1"])]
    df = spark.createDataFrame(rows, "doc long, at long, line string")
    out = sorted((r.start if r.start is not None else -1, r.title, r.n_lines, r.body) for r in O.sections(df, "doc", "at", "line", F.col("line").startswith("#")).collect())
    assert out == [(-1, None, 1, "before"), (1, "# A", 2, "a1\na2"), (4, "# B", 0, ""), (5, "# C", 1, "c1")]


def test_trails_and_links(spark):
    urls = ["https://x.org/my-book/ch_2//index.html", "https://x.org", None, "https://x.org/a?b/?q=1"]
    got = [list(r[0]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(O.breadcrumbs(F.col("u"))).collect()]
    want = [[p.replace("-", " ").replace("_", " ").title() for p in (u or "").split("/")[3:] if p and not p.startswith("?")] for u in urls]
    assert got == want
    one = spark.createDataFrame([(["http://a.Own.org", "/rel", "https://b"],)], "l array<string>").select(O.links_by_side(F.col("l"), "own").alias("s")).first().s
    assert (list(one.internal), list(one.external)) == (["http://a.Own.org"], ["https://b"])
