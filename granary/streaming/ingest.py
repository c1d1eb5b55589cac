"""Incremental ingestion and activity streams (ST1-ST10): files as they come, duplicates, late rows, windows.

History is a table, not streaming state: each micro-batch is anti-joined with the keys seen so far. Windows keep state
only within the watermark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.linking import first_seen


def files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most so many a batch (ST1, ST6)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def new_only(batch: DataFrame, history: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """Of each key the first row of the batch, if history doesn't have the key; rows without a key all stay (ST4)."""
    return first_seen(batch, [key], order).join(history.select(key), key, "left_anti").select(*batch.columns)


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str, order: Sequence[str], route: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """All files there are, appended to target once per key (ST1, ST4, ST5).

    Each batch writes a folder of its own run (that is, checkpoint) and number, overwriting what a failed attempt may have
    left, so a batch that runs again gives the same table. A new run over an existing target adds to what is there.
    """
    run = hashlib.md5(checkpoint.encode(), usedforsecurity=False).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = new_only(batch, _history(spark, target, run, number, batch.schema, key), key, order)
        (route(rows) if route else rows).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _history(spark: SparkSession, target: str, run: str, number: int, schema: T.StructType, key: str) -> DataFrame:
    """The keys that other runs and earlier batches have written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], T.StructType([schema[key]]))
    held = T.StructType([schema[key], T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(held).parquet(target).where((F.col("run") != run) | (F.col("batch") < number)).select(key)


def tumbling(events: DataFrame, ts: str, size: str, by: Sequence[str], late: str | None = None) -> DataFrame:
    """start, keys, n, total per window of fixed size; late rows beyond the watermark are left out in a stream (ST10)."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, ts: str, size: str, step: str, by: Sequence[str]) -> DataFrame:
    """start, keys, n per window of this size every step."""
    out = events.groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: Sequence[str], late: str | None = None) -> DataFrame:
    """start, end, keys, n of runs of events with less than `gap` between them."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def unique_within(stream: DataFrame, key: Sequence[str], ts: str, late: str) -> DataFrame:
    """A stream without rows that repeat a key within the watermark (ST4, the bounded part)."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))
