"""Structure of texts (W9-W11, X18, X40): headings and what stands under them, extractive summaries, trails of addresses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes a sentence important, its least length, the length of a summary.
MARKERS = ("important", "key", "main", "critical", "essential")
LEAST, MOST = 20, 500


def summary(text: Column, terms: Sequence[str], markers: Sequence[str] = MARKERS, least: int = LEAST, most: int = MOST) -> Column:
    """The sentences of the highest score, best first, up to the first that would pass `most` characters.

    A term counts two and a marker one, once a sentence; of equal scores the earlier is first. Without a sentence that
    fits it is the text's beginning; a null text gives an empty summary.
    """
    text = F.coalesce(text, F.lit(""))

    def score(s: Column) -> Column:
        low = F.lower(s)
        parts = [F.when(F.contains(low, F.lit(t)), 2).otherwise(0) for t in terms] + [F.when(F.contains(low, F.lit(m)), 1).otherwise(0) for m in markers]
        return reduce(lambda a, b: a + b, parts, F.lit(0))

    rated = F.transform(F.split(text, "[.!?]+", -1), lambda s, i: F.struct((-score(s)).alias("score"), i.alias("i"), s.alias("s")))
    rated = F.array_sort(F.filter(rated, lambda r: F.length(r["s"]) >= least))
    start = F.struct(F.lit(0).alias("size"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, r: Column) -> Column:
        full = acc["full"] | (acc["size"] + F.length(r["s"]) > most)
        return F.struct(F.when(full, acc["size"]).otherwise(acc["size"] + F.length(r["s"])).alias("size"), full.alias("full"), F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.trim(r["s"])))).alias("kept"))

    kept = F.aggregate(rated, start, step, lambda acc: acc["kept"])
    return F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.concat(F.array_join(k, ". "), F.lit("."))).otherwise(F.substring(text, 1, most))), 0)


def outline(headings: DataFrame, doc: str, position: str, level: str, title: str, deepest: int = 6) -> DataFrame:
    """headings with parent, the title of the last one above of a lower level, path, from the top, and until, where the section ends.

    A section ends where the next heading of its own or a lower level begins; null at the document's end.
    """
    before = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(doc).orderBy(position).rowsBetween(1, Window.unboundedFollowing)
    here = F.struct(F.col(position).alias("at"), F.col(title).alias("title"))
    rows = headings
    for k in range(1, deepest + 1):
        rows = rows.withColumn(f"_last{k}", F.last(F.when(F.col(level) == k, here), ignorenulls=True).over(before))
        rows = rows.withColumn(f"_next{k}", F.first(F.when(F.col(level) == k, F.col(position)), ignorenulls=True).over(after))
    # an open heading of level k is one that no later heading of a lower level has closed
    chain: list[Column] = []
    for k in range(1, deepest + 1):
        closed = F.lit(False)
        for j in range(1, k):
            closed = closed | F.coalesce(F.col(f"_last{j}.at") > F.col(f"_last{k}.at"), F.lit(False))
        chain.append(F.when((F.col(level) > k) & ~closed, F.col(f"_last{k}.title")))
    until = F.least(*(F.when(F.col(level) >= k, F.col(f"_next{k}")) for k in range(1, deepest + 1)), F.lit(None).cast("long"))
    above = F.array_compact(F.array(*chain))
    out = rows.withColumn("_above", above).withColumn("until", until.cast("long"))
    return out.select(*headings.columns, F.get("_above", F.size("_above") - 1).alias("parent"), F.concat("_above", F.array(title)).alias("path"), "until")


def sections(lines: DataFrame, doc: str, position: str, text: str, heading: Column) -> DataFrame:
    """doc, start, title, n_lines and body: the lines from each heading to the next one; those before the first have a null title."""
    rows = lines.select(F.col(doc).alias("doc"), F.col(position).alias("at"), F.col(text).alias("line"), heading.alias("heading"))
    so_far = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.last(F.when(F.col("heading"), F.col("at")), ignorenulls=True).over(so_far))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("at", "line")))), lambda x: x["line"])
    out = rows.groupBy("doc", "start").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("title"), F.count_if(~F.col("heading")).alias("n_lines"), F.array_join(body, "\n").alias("body"))
    return out.select(F.col("doc").alias(doc), "start", "title", "n_lines", "body")


def title_case(text: Column) -> Column:
    """Each letter after another character, or first, is a capital, others are small."""
    chars = F.split(text, "")
    return F.get(F.transform(F.array(chars), lambda cs: F.array_join(F.transform(cs, lambda c, i: F.when(F.coalesce(F.get(cs, i - 1), F.lit(" ")).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c))), "")), 0)


def breadcrumbs(url: Column) -> Column:
    """The parts of the path as titles; empty ones and those that begin a query string are left out."""
    parts = F.split(F.coalesce(url, F.lit("")), "/", -1)
    parts = F.filter(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), lambda p: (p != "") & ~p.startswith("?"))
    return F.transform(parts, lambda p: title_case(F.translate(p, "-_", "  ")))


def links_by_side(links: Column, own: str) -> Column:
    """Struct (internal, external) of the absolute links, in order: internal ones contain `own`, whatever the case."""
    absolute = F.filter(links, lambda u: u.startswith("http"))
    return F.struct(F.filter(absolute, lambda u: F.contains(F.lower(u), F.lit(own.lower()))).alias("internal"), F.filter(absolute, lambda u: ~F.contains(F.lower(u), F.lit(own.lower()))).alias("external"))
