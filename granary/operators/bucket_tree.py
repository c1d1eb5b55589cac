"""Buckets within buckets (P19, P25, A15): counts and sums by several levels of keys, the best few of each level, as nested structs.

Rows are counted once, by all keys together; the counts of a level are sums of those of the level below, so the table is read and
shuffled once. The best of each parent are chosen by parts first, so that a parent with very many children is no single task, and
only chosen buckets carry their children up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import durable

SPREAD = 16


def _best(rows: DataFrame, parents: Sequence[str], key: str, top: int) -> DataFrame:
    order = [F.desc("n"), F.col(key)]
    part = F.pmod(F.xxhash64(key), F.lit(SPREAD)).alias("_part")
    some = rows.select("*", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*parents, "_part").orderBy(*order))).where(F.col("_rank") <= top)
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(*parents).orderBy(*order))).where(F.col("_rank") <= top).drop("_part")


def _fields(children: Column, names: Sequence[str]) -> Column:
    return F.transform(children, lambda b: F.struct(*(b[c].alias(c) for c in names)))


def bucket_tree(df: DataFrame, levels: Sequence[str], tops: Sequence[int], sums: Sequence[str] = ()) -> DataFrame:
    """key, n, <sums> and buckets, the children as an array of the same, best first; one row for each of the best of the first level.

    Rows without a key of some level count in the levels above it, but in no bucket of that one or below. Ties go to
    the smaller key; `n` is the number of rows.
    """
    counts = durable(df.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"_{c}") for c in sums)))
    below: DataFrame | None = None
    for depth in range(len(levels), 0, -1):
        keys, key, parents = list(levels[:depth]), levels[depth - 1], list(levels[: depth - 1])
        known = counts.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        rows = known.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"_{c}").alias(c) for c in sums))
        rows = _best(rows, parents, key, tops[depth - 1])
        if below is not None:
            rows = rows.join(below, keys, "left")
        fields = [F.col(key).alias("key"), F.col("n"), *(F.col(c) for c in sums), *([F.col("buckets")] if below is not None else [])]
        if depth == 1:
            return rows.select("_rank", *fields).orderBy("_rank").drop("_rank")
        children = F.array_sort(F.collect_list(F.struct("_rank", *fields)))  # at most the level's top
        names = ["key", "n", *sums, *(["buckets"] if below is not None else [])]
        below = rows.groupBy(*parents).agg(_fields(children, names).alias("buckets"))
    raise ValueError("a tree needs a level")


def flattened(tree: DataFrame, depth: int, sums: Sequence[str] = ()) -> DataFrame:
    """level, path (the keys joined by ` > `), rank, n, <sums> of every bucket of a tree of so many levels."""
    out, rows = [], tree.select(F.col("key").cast("string").alias("path"), "n", *sums, *(["buckets"] if depth > 1 else []))
    whole = Window.orderBy(F.desc("n"), "path")  # the first level's top
    rows = rows.withColumn("rank", F.row_number().over(whole))
    for level in range(1, depth + 1):
        out.append(rows.select(F.lit(level).alias("level"), "path", F.col("rank").cast("long").alias("rank"), "n", *sums))
        if level < depth:
            each = rows.select("path", F.posexplode("buckets").alias("i", "b"))
            more: list[Column] = [F.col("b.n").alias("n"), *(F.col(f"b.{c}").alias(c) for c in sums), *([F.col("b.buckets").alias("buckets")] if level + 1 < depth else [])]
            rows = each.select(F.concat("path", F.lit(" > "), F.col("b.key").cast("string")).alias("path"), (F.col("i") + 1).alias("rank"), *more)
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
