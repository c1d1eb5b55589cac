"""Bucket and metric aggregations (A1-A30, P18-P20, P23, P27, P31): terms, calendars, ranges, nested elements, metrics.

All are one groupBy (partial aggregation before the shuffle); top-k per parent uses row_number, which Spark turns into
a group limit before the shuffle. Calendars are filled in from a spine of the buckets between first and last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.session import durable


def _values(df: DataFrame, field: str) -> DataFrame:
    """One row for each value of the field: distinct ones of an array, elements of an array of structs ("authors.name")."""
    head, _, rest = field.partition(".")
    if isinstance(df.schema[head].dataType, T.ArrayType):
        array = F.col(head) if rest else F.array_distinct(F.col(head))
        return df.withColumn("_e", F.explode(array)).withColumn("key", F.col(f"_e.{rest}" if rest else "_e")).drop("_e")
    return df.withColumn("key", F.col(field))


def terms(df: DataFrame, field: str, size: int | None = 10, order: str = "count", metrics: Sequence[Column] = ()) -> DataFrame:
    """key, doc_count and metrics of the `size` largest values, ties by key; order "key" sorts by key instead."""
    rows = _values(df, field).where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"), *metrics)
    rows = rows.orderBy(*([F.desc("doc_count")] if order == "count" else []), "key")
    return rows.limit(size) if size else rows


def top_per_parent(df: DataFrame, parent: Sequence[str], field: str, size: int) -> DataFrame:
    """parent columns, key, doc_count, rank: the `size` largest values within each parent."""
    rows = _values(df, field).where(F.col("key").isNotNull()).groupBy(*parent, "key").agg(F.count(F.lit(1)).alias("doc_count"))
    order = Window.partitionBy(*parent).orderBy(F.desc("doc_count"), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def calendar(df: DataFrame, ts: str, unit: str, metrics: Sequence[Column] = (), fill: bool = True) -> DataFrame:
    """bucket, doc_count and metrics by year, quarter, month, week or day; empty buckets in between have 0 (A4)."""
    rows = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)
    if not fill:
        return rows
    step = {"year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAY", "day": "INTERVAL 1 DAY"}[unit]
    spine = rows.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias("bucket"))
    return spine.join(rows, "bucket", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def stats(df: DataFrame, field: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, max, avg, sum."""
    c = F.col(field)
    return df.groupBy(*by).agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sum(c).alias("sum"))


def stats_rows(df: DataFrame, field: str) -> DataFrame:
    """The five stats as (key, value) rows, rounded to 4 places."""
    names = ("count", "min", "max", "avg", "sum")
    wide = stats(df, field).select(*(F.round(F.col(n).cast("double"), 4).alias(n) for n in names))
    return wide.unpivot([], list(names), "key", "value")


PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def percentiles(df: DataFrame, field: str, percents: Sequence[float] = PERCENTS, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """(key, value) rows p1, p5, ...: interpolated if exact, else by a bounded sketch in one pass."""
    names = [f"p{p:g}" for p in percents]
    if exact:
        found = dict(zip(names, value_at(df, field, [p / 100 for p in percents]), strict=True))
        return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in found.items())).unpivot([], names, "key", "value")
    value = F.percentile_approx(F.col(field).cast("double"), F.array(*(F.lit(p / 100) for p in percents)), accuracy)
    return df.agg(value.alias("v")).select(F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("key"), F.col("v").alias("value"))).alias("e")).select("e.key", "e.value")


def value_at(df: DataFrame, field: str, shares: Sequence[float]) -> list[float | None]:
    """The interpolated quantiles of the field's values, nulls left out; None for each if there is no value.

    Values are counted, the counts sorted by range, and each range's running count starts from those before it, so no task
    holds more than a range; two values a quantile come to the driver.
    """
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.sum("n").alias("rows"))  # one row a range
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    until = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("before")
    placed = counts.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("until", until)
    total = parts.agg(F.sum("rows")).first()[0]
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    wanted = sorted({math.floor(p) for p in places} | {math.ceil(p) for p in places})
    row = placed.agg(*(F.min(F.when(F.col("until") > k, F.col("v"))).alias(f"v{k}") for k in wanted)).first()
    return [row[f"v{math.floor(p)}"] + (row[f"v{math.ceil(p)}"] - row[f"v{math.floor(p)}"]) * (p - math.floor(p)) for p in places]


def cardinality(df: DataFrame, field: str, exact: bool = False) -> DataFrame:
    """Distinct values, of elements too (A7, A8): a sketch, or exactly."""
    key = F.col("key")
    return _values(df, field).agg((F.count_distinct(key) if exact else F.approx_count_distinct(key, 0.01)).alias("distinct"))


def ranges(df: DataFrame, field: str, bounds: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """key, doc_count of the named ranges, the upper bound outside; a value may be in several or none."""
    c = F.col(field)

    def inside(low: float | None, high: float | None) -> Column:
        return (c >= low if low is not None else c.isNotNull()) & (c < high if high is not None else c.isNotNull())

    counts = df.agg(*(F.count_if(inside(a, b)).alias(k) for k, a, b in bounds))
    return counts.unpivot([], [k for k, _, _ in bounds], "key", "doc_count")


def filter_counts(df: DataFrame, by: Sequence[str], predicates: dict[str, Column], metrics: Sequence[Column] = ()) -> DataFrame:
    """Rows, and rows that satisfy each predicate, in one pass."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("doc_count"), *(F.count_if(p).alias(n) for n, p in predicates.items()), *metrics)


def several(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, key, doc_count) of several single-valued fields in one pass by grouping sets."""
    grouped = df.groupingSets([[F.col(f)] for f in fields], *(F.col(f) for f in fields)).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("doc_count"))
    n = len(fields)
    name = reduce(lambda out, i: F.when(F.col("_g") == (2**n - 1) ^ (1 << (n - 1 - i)), fields[i]).otherwise(out), range(n), F.lit(None).cast("string"))
    return grouped.select(name.alias("field"), F.coalesce(*(F.col(f).cast("string") for f in fields)).alias("key"), "doc_count")


def wide_series(df: DataFrame, key: str, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per key and a column for each named series; missing values are 0."""
    return df.groupBy(key).pivot(series, list(names)).agg(F.sum(value)).na.fill(0)


def largest_series(df: DataFrame, series: str, value: str, size: int) -> list[str]:
    """Names of the `size` series with the largest totals: a bounded list, as the columns of a pivot have to be."""
    return [r[0] for r in df.groupBy(series).agg(F.sum(value).alias("t")).orderBy(F.desc("t"), series).limit(size).collect()]


def merged_buckets(buckets: DataFrame, names: dict[str, str]) -> DataFrame:
    """Bucket keys renamed, whatever their case; equal new names are summed, largest first."""
    known = F.create_map(*(F.lit(x) for k, v in names.items() for x in (k.lower(), v)))
    key = F.coalesce(known[F.lower("key")], F.col("key"))
    return buckets.groupBy(key.alias("key")).agg(F.sum("doc_count").alias("doc_count")).orderBy(F.desc("doc_count"), "key")


#: Milliseconds of a day, and the first that no date reaches.
_DAY, _NO_DATE = 86400000, 2**31 * 86400000


def bucket_key(value: Column) -> Column:
    """Numbers above 10^12 are milliseconds and become dates (UTC), years beyond 9999 without a sign; the rest becomes text (P20).

    So do numbers beyond the last date, in the year 5,881,580.
    """
    number = value.cast("double")
    is_date = (number > 1e12) & (number < _NO_DATE)
    ms = F.when(is_date, value).cast("long")
    days = ((ms - ms % _DAY) / _DAY).cast("int")  # a multiple of a day, so that the division is exact
    return F.when(is_date, F.ltrim(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("+"))).otherwise(value.cast("string"))
