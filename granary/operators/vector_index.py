"""An inverted-file index of vectors and the relations it feeds (L24): coarse centroids, lists by centroid, a few lists a query.

fit() places the centroids on a bounded sample (`sample` rows, chosen by a hash of the id); write_index() assigns every row to its
nearest one, inside tasks, and stores the rows by list. A list is cut into blocks of about `block` rows, so a centroid that a
third of the rows are nearest to is many tasks. A query goes to the blocks of its `probes` nearest lists; each block answers with
its best rows, and a query's best of all blocks are its neighbours.

Defined cases: rows without a vector, with one of another length, or of length zero are not indexed; equal vectors are all found;
ties go to the smaller id; a query finds its own row unless `others` leaves it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that the centroids are fitted on at most, rows of a block about, queries compared with a block at once.
SAMPLE, BLOCK, AT_ONCE = 50_000, 20_000, 1024


@dataclass(frozen=True)
class VectorIndex:
    """rows (id: long, v: array<float>, list, block) as stored, the centroids (lists x dimensions), and the blocks of each list."""

    rows: DataFrame
    centroids: np.ndarray
    blocks: tuple[int, ...]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, size: int | None) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull()))
    return rows if size is None else rows.where(F.size("v") == size)


def fit(vectors: DataFrame, id_col: str, vector_col: str, lists: int, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Unit centroids by KMeans on the cosine distance, at most `lists`, from at most `sample` rows; without rows, none."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _usable(vectors, id_col, vector_col, None)
    some = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    usual = some.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    if usual is None:
        return np.zeros((0, 1))
    model = KMeans(k=max(2, lists), seed=seed, distanceMeasure="cosine", featuresCol="x", maxIter=15).fit(some.where(F.size("v") == usual["n"]).select(array_to_vector("v").alias("x")))
    return _unit(np.array(model.clusterCenters()))


def _assigner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                x = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((_unit(x) @ centroids.T).argmax(axis=1).astype(np.int32))], ["id", "v", "list"])

    return run


def write_index(vectors: DataFrame, id_col: str, vector_col: str, path: str, lists: int, block: int = BLOCK, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """Stores every usable row under path by list and block, and returns the index."""
    spark = vectors.sparkSession
    centroids = fit(vectors, id_col, vector_col, lists, sample, seed)
    rows = _usable(vectors, id_col, vector_col, centroids.shape[1])
    shared = spark.sparkContext.broadcast(centroids)
    rows.mapInArrow(_assigner(shared), "id long, v array<float>, list int").write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = {r["list"]: r["n"] for r in assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a list
    blocks = tuple(-(-sizes.get(k, 0) // block) for k in range(len(centroids)))
    many = F.get(F.array(*map(F.lit, blocks)), F.col("list")) if blocks else F.lit(1)
    placed = assigned.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))
    placed.repartitionByRange("list", "block", "id").sortWithinPartitions("list", "block").write.parquet(f"{path}/rows")
    np_rows = [(k, [float(x) for x in c], b) for k, (c, b) in enumerate(zip(centroids, blocks, strict=True))]
    spark.createDataFrame(np_rows, "list int, centroid array<double>, blocks int").coalesce(1).write.parquet(f"{path}/lists")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # bounded by the number of lists
    return VectorIndex(spark.read.parquet(f"{path}/rows"), np.array([r["centroid"] for r in lists]), tuple(r["blocks"] for r in lists))


def _prober(shared, probes: int):
    """Rows (id, v) to one row for each block of each probed list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, blocks = shared.value
        held = np.array(blocks)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                near = _unit(np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)) @ centroids.T
                near[:, held == 0] = -np.inf
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                owner, which, block = [], [], []
                for row, found in enumerate(best.tolist()):
                    for k in found:
                        owner += [row] * int(held[k])
                        which += [k] * int(held[k])
                        block += range(int(held[k]))
                take = part.take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(which, pa.int32()), pa.array(block, pa.int32())], ["id", "v", "list", "block"])

    return run


def _best(size: int, least: float, others: bool):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            order = np.argsort(rows["id"].to_numpy(), kind="stable")
            ids, x = rows["id"].to_numpy()[order], _unit(np.array(rows["v"].tolist(), np.float64)[order])
            for at in range(0, len(queries), AT_ONCE):
                names = queries["id"].to_numpy()[at : at + AT_ONCE]
                near = np.round(_unit(np.array(queries["v"].tolist()[at : at + AT_ONCE], np.float64)) @ x.T, 9)
                if others:
                    near[names[:, None] == ids[None]] = -np.inf
                bar = np.partition(near, -size, axis=1)[:, -size] if len(ids) > size else np.full(len(names), -np.inf)
                row, col = np.nonzero((near >= bar[:, None]) & (near >= least))  # a few, and what ties with the last of them
                order = np.lexsort((col, -near[row, col], row))
                row, col = row[order], col[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < size
                row, col = row[first], col[first]
                out.append(pd.DataFrame({"query": names[row], "id": ids[col], "similarity": near[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    return run


def search(index: VectorIndex, queries: DataFrame, id_col: str, vector_col: str, size: int = 10, probes: int = 8, least: float = -1.0, others: bool = True) -> DataFrame:
    """query, id, similarity, rank: of each query the best `size` rows of its `probes` nearest lists, by cosine."""
    shape = "query long, id long, similarity double"
    spark = index.rows.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], f"{shape}, rank int")
    shared = spark.sparkContext.broadcast((index.centroids, index.blocks))
    asked = _usable(queries, id_col, vector_col, index.centroids.shape[1]).mapInArrow(_prober(shared, probes), "id long, v array<float>, list int, block int")
    found = asked.groupBy("list", "block").cogroup(index.rows.groupBy("list", "block")).applyInPandas(_best(size, least, others), shape)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")  # at most size rows a probed block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def probes_for(index: VectorIndex, vectors: DataFrame, id_col: str, vector_col: str, size: int = 10, target: float = 0.95, queries: int = 200, seed: int = 11) -> int:
    """The least number of lists a query that finds `target` of the true neighbours of at most `queries` rows, chosen by a hash of the id.

    Their true neighbours come from one search of all lists; in which list each lies, and when a query would come to it, gives
    the recall of every number of lists at once.
    """
    if not len(index.centroids):
        return 1
    some = vectors.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(queries)
    exact = search(index, some, id_col, vector_col, size, probes=len(index.centroids))
    places = exact.join(index.rows.select("id", "list"), "id").select("query", "list").collect()  # at most queries times size
    asked = {r["id"]: r["v"] for r in _usable(some, id_col, vector_col, index.centroids.shape[1]).collect()}
    when = []
    for query in {r["query"] for r in places}:
        near = _unit(np.array([asked[query]], np.float64))[0] @ index.centroids.T
        near[np.array(index.blocks) == 0] = -np.inf
        turn = {k: i + 1 for i, k in enumerate(np.argsort(-near, kind="stable").tolist())}
        when += [turn[r["list"]] for r in places if r["query"] == query]
    return int(np.sort(when)[max(0, int(np.ceil(target * len(when))) - 1)]) if when else 1


def relations(kinds: dict[str, DataFrame]) -> DataFrame:
    """src, dst, kind, weight of all kinds in one edge table; kinds: name to (src, dst, weight). The greatest weight of a repeated edge counts."""
    each = [df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(kind).alias("kind"), F.col("weight").cast("double").alias("weight")) for kind, df in kinds.items()]
    rows = reduce(lambda a, b: a.unionByName(b), each)
    return rows.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query, id) pairs that were found."""
    both = exact.select("query", "id").distinct().join(found.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left")
    total, hits = both.agg(F.count(F.lit(1)), F.count("hit")).first()
    return hits / total if total else 1.0
