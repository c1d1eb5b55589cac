"""Review workflow and keyed tables (SK1-SK13, SK17-SK19, P9-P13, T3, Z27-Z30): routing, actions, upserts, swaps.

Tables are DataFrames keyed by id; an action set is a DataFrame of (id, action, ...). Every mutation is a join that
gives the next version of a table, written to a new path; no file is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the queue that the content table doesn't have.
WORKFLOW = ("status", "priority", "priority_level", "submitted_date", "reviewed_date", "reviewer_id", "rejection_reason")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows, and those of the table with other keys (SK1-SK3)."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def patch(table: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """The table with the changes' non-null fields (SK4, SK5, SK14, SK15)."""
    new = changes.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    out = table.join(new, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def delete_where(table: DataFrame, gone: Column) -> DataFrame:
    """Rows for which the predicate is not true (SK6)."""
    return table.where(~F.coalesce(gone, F.lit(False)))


def add_counts(table: DataFrame, events: DataFrame, counter: str, key: str = "id") -> DataFrame:
    """The table's counter with one more for each event of its key (SK7)."""
    seen = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return table.join(seen, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def approve(queue: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Content rows of the approved ids: all fields but the workflow's, the mean of both scores, counters from 0 (SK8)."""
    rows = queue.join(actions.where("action = 'approve'").select("id", F.col("reviewer").alias("approved_by"), F.col("categories").alias("_c")), "id")
    rows = rows.withColumn("final_score", (F.coalesce("ml_score", F.lit(0.0)) + F.coalesce("ai_confidence", F.lit(0.0))) / 2)
    rows = rows.withColumn("categories", F.coalesce("_c", "categories")).withColumn("approval_status", F.lit("approved")).withColumn("approved_at", as_of)
    for counter in ("view_count", "bookmark_count", "share_count"):
        rows = rows.withColumn(counter, F.coalesce(counter, F.lit(0)) if counter in rows.columns else F.lit(0))
    return rows.drop("_c", *WORKFLOW)


def review(queue: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """The queue after approve, reject and pending actions (SK8-SK10, SK12)."""
    status = F.create_map(F.lit("approve"), F.lit("approved"), F.lit("reject"), F.lit("rejected"), F.lit("pending"), F.lit("pending"))
    new = actions.select("id", status[F.col("action")].alias("_s"), F.col("reviewer").alias("_r"))
    out = queue.join(new, "id", "left")
    changed = F.col("_s").isNotNull()
    return out.withColumn("status", F.coalesce("_s", "status")).withColumn("reviewer_id", F.when(changed, F.col("_r")).otherwise(F.col("reviewer_id"))).withColumn("reviewed_date", F.when(changed, as_of).otherwise(F.col("reviewed_date"))).drop("_s", "_r")


def outcomes(actions: DataFrame, queue: DataFrame) -> DataFrame:
    """id, outcome: success for ids that the queue has, failed for others (SK11)."""
    return actions.select("id").join(queue.select("id", F.lit(True).alias("_there")), "id", "left").select("id", F.when(F.col("_there"), "success").otherwise("failed").alias("outcome"))


def queue_order(queue: DataFrame, pending: bool = True) -> DataFrame:
    """By final score and priority, nulls last, then oldest first while pending, else newest first."""
    return queue.orderBy(F.desc_nulls_last("final_score"), F.desc_nulls_last("priority"), F.asc("submitted_date") if pending else F.desc("submitted_date"), "id")


def coalesced(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """Columns of older names under the present one, the first that has a value."""
    out = df
    for name, older in names.items():
        there = [c for c in (name, *older) if c in df.columns]
        out = out.withColumn(name, F.coalesce(*there) if there else F.lit(None))
    return out.drop(*{o for older in names.values() for o in older})


def score_defaults(df: DataFrame) -> DataFrame:
    """Missing final scores are the mean of model and other score, missing quality is 0.5."""
    mean = (F.coalesce("ml_score", F.lit(0.0)) + F.coalesce("ai_confidence", F.lit(0.0))) / 2
    return df.withColumn("final_score", F.coalesce("final_score", mean)).withColumn("quality_score", F.coalesce("quality_score", F.lit(0.5)))


def swap(spark: SparkSession, rows: DataFrame, base: str, version: str, view: str) -> int:
    """Writes a new version, checks its row count, and points the view to it (SK13); the rows that it has."""
    path = f"{base}/{version}"
    rows.write.parquet(path)
    new = spark.read.parquet(path)
    wanted, got = rows.count(), new.count()
    if wanted != got:
        raise ValueError(f"{path} has {got} rows instead of {wanted}")
    new.createOrReplaceTempView(view)
    return got
