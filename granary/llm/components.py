"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed


def spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (a, b) that a task meets, those that join two parts not joined before: less than its nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        kept = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*kept, strict=True)], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Large: each node hangs its larger neighbours on its smallest; small: its smaller ones."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))  # no more rows than edges
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a > b").distinct()


#: Edges of a partition, at most about: a small table needs few tasks and files.
ROWS = 20_000


def _sign(edges: DataFrame) -> tuple:
    """Number and fingerprint of the edges."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.expr("b % 1000003"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) to (node, root): the smallest node that each node reaches. Nodes without an edge are left out.

    Only counters come to the driver. A hub with very many edges is one key of a join, which adaptive execution splits.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _sign(edges)
    while sign[0]:  # edges that already hang on their smallest node stay as they are, and one step shows it
        before = sign
        edges = checkpointed(_star(_star(edges, True), False).coalesce(max(1, -(-sign[0] // ROWS))))
        sign = _sign(edges)
        if sign == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
