"""Multi-step analyses (A31-A34, W2-W6, P28, P29, J18, J22, J23): shares over time, surges, concentration, drill-down.

Inputs are reduced to one row per (year, entity) by a groupBy; the windows run over that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def yearly_counts(df: DataFrame, year: Column, entity: Column, distinct_id: Column | None = None) -> DataFrame:
    """year, entity, n: elements, or distinct documents if their id is given."""
    n = F.count_distinct(distinct_id) if distinct_id is not None else F.count(F.lit(1))
    return df.where(year.isNotNull() & entity.isNotNull()).groupBy(year.alias("year"), entity.alias("entity")).agg(n.alias("n"))


def shares(counts: DataFrame, totals: DataFrame, top: int = 5, per_year: int | None = None) -> DataFrame:
    """year, entity, n, total, share (percent, 1 place) of the `top` entities over all years.

    totals: year, total. per_year: count only each year's so many largest, as an index with truncated lists does (D3).
    """
    if per_year:
        order = Window.partitionBy("year").orderBy(F.desc("n"), "entity")
        counts = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_year).drop("_r")
    best = counts.groupBy("entity").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "entity").limit(top).select("entity")
    rows = counts.join(F.broadcast(best), "entity", "left_semi").join(totals, "year")
    return rows.select("year", "entity", "n", "total", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("share"))


def share_changes(shares_: DataFrame) -> DataFrame:
    """entity, first_share, last_share, change, relative_change in percent."""
    ends = shares_.groupBy("entity").agg(F.min_by("share", "year").alias("first_share"), F.max_by("share", "year").alias("last_share"))
    change = F.col("last_share") - F.col("first_share")
    return ends.select("entity", "first_share", "last_share", F.round(change, 1).alias("change"), F.round(F.when(F.col("first_share") > 0, change / F.col("first_share") * 100).otherwise(0.0), 1).alias("relative_change"))


def surges(per_year: DataFrame, threshold: float = 30.0) -> DataFrame:
    """year, n, previous, growth: years that grew by more than `threshold` percent over the year before in the data."""
    rows = per_year.withColumn("previous", F.lag("n").over(Window.orderBy("year")))  # a row a year
    rows = rows.where(F.col("previous") > 0).withColumn("growth", F.round((F.col("n") - F.col("previous")) * 100.0 / F.col("previous"), 1))
    return rows.where((F.col("n") - F.col("previous")) * 100.0 / F.col("previous") > threshold)


def with_events(surges_: DataFrame, events: DataFrame, none: str = "No known event") -> DataFrame:
    """surges with each year's event (J18, P28); events: year, event."""
    return surges_.join(events, "year", "left").withColumn("event", F.coalesce("event", F.lit(none)))


def contributors(counts: DataFrame, years: DataFrame, top: int = 5) -> DataFrame:
    """year, entity, n, rank: the largest entities of the given years."""
    order = Window.partitionBy("year").orderBy(F.desc("n"), "entity")
    return counts.join(years.select("year"), "year", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def concentration(counts: DataFrame, top: int = 5) -> DataFrame:
    """year, entities, gini (3 places), top_share and rest_share (percent, 1 place), for years with two entities or more."""
    up = Window.partitionBy("year").orderBy("n", "entity")
    down = Window.partitionBy("year").orderBy(F.desc("n"), "entity")
    rows = counts.withColumn("i", F.row_number().over(up)).withColumn("d", F.row_number().over(down))
    agg = rows.groupBy("year").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("s"), F.sum(F.col("i") * F.col("n")).alias("w"), F.sum(F.when(F.col("d") <= top, F.col("n")).otherwise(0)).alias("t")).where("entities > 1")
    gini = F.when(F.col("s") > 0, 2.0 * F.col("w") / (F.col("entities") * F.col("s")) - (F.col("entities") + 1.0) / F.col("entities")).otherwise(0.0)
    share = F.when(F.col("s") > 0, F.col("t") * 100.0 / F.col("s")).otherwise(0.0)
    return agg.select("year", "entities", F.round(gini, 3).alias("gini"), F.round(share, 1).alias("top_share"), F.round(100 - share, 1).alias("rest_share"))


def trend(per_year: DataFrame, value: str = "gini", margin: float = 0.05) -> DataFrame:
    """One row: early and late mean of three years, and increasing, decreasing, stable or insufficient_data."""
    rows = per_year.withColumn("a", F.row_number().over(Window.orderBy("year"))).withColumn("z", F.row_number().over(Window.orderBy(F.desc("year"))))
    one = rows.agg(F.count(F.lit(1)).alias("years"), F.avg(F.when(F.col("a") <= 3, F.col(value))).alias("early"), F.avg(F.when(F.col("z") <= 3, F.col(value))).alias("late"))
    gap = F.col("late") - F.col("early")
    word = F.when(F.col("years") < 3, "insufficient_data").when(gap > margin, "increasing").when(gap < -margin, "decreasing").otherwise("stable")
    return one.select("years", F.round("early", 4).alias("early"), F.round("late", 4).alias("late"), word.alias("trend"))


def narrative(changes: DataFrame) -> DataFrame:
    """entity and a sentence on its share."""
    word = F.when(F.col("change") > 0, "rose").when(F.col("change") < 0, "fell").otherwise("held")
    return changes.select("entity", F.format_string("%s %s from %.1f%% to %.1f%%", "entity", word, "first_share", "last_share").alias("text"))


def drill_down(df: DataFrame, path: dict[str, object], dimension: str, size: int = 10) -> DataFrame:
    """key, doc_count of the next dimension within the values clicked so far."""
    for field, value in path.items():
        df = df.where(F.col(field) == F.lit(value))
    return df.groupBy(F.col(dimension).alias("key")).agg(F.count(F.lit(1)).alias("doc_count")).orderBy(F.desc("doc_count"), "key").limit(size)


def within_result(df: DataFrame, field: str, previous: DataFrame) -> DataFrame:
    """Rows whose field is among the keys of an earlier result."""
    return df.join(previous.select(F.col("key").alias(field)), field, "left_semi")


def trends(rows: DataFrame, term: str, ts: str, now: Column, days: int = 30, tolerance: float = 0.1) -> DataFrame:
    """term, n, before, trend: counts of the last days and of as many before them; up, down or stable within the tolerance.

    Both periods are counted in one pass over the rows of these days; a term of one period alone is up or down.
    """
    start, middle = now - F.make_interval(days=F.lit(2 * days)), now - F.make_interval(days=F.lit(days))
    two = rows.where((F.col(ts) > start) & (F.col(ts) <= now) & F.col(term).isNotNull())
    counts = two.groupBy(term).agg(F.count_if(F.col(ts) > middle).alias("n"), F.count_if(F.col(ts) <= middle).alias("before"))
    trend = F.when(F.col("n") > F.col("before") * (1 + tolerance), "up").when(F.col("n") < F.col("before") * (1 - tolerance), "down").otherwise("stable")
    return counts.withColumn("trend", trend)


def range_shares(df: DataFrame, score: str, bounds: Sequence[float]) -> DataFrame:
    """range, n, percentage: rows from one bound to below the next, the last bound included.

    Every range has a row; scores beyond the bounds and null ones count in none, and the percentages are of those that count.
    """
    at = F.lit(None).cast("int")
    for i in range(len(bounds) - 1):
        below = F.col(score) <= bounds[i + 1] if i == len(bounds) - 2 else F.col(score) < bounds[i + 1]
        at = F.when((F.col(score) >= bounds[i]) & below, i).otherwise(at)
    counted = df.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    ranges = df.sparkSession.createDataFrame([(i, f"{a:g}-{b:g}") for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], "at int, range string")
    rows = ranges.join(counted, "at", "left").na.fill(0, ["n"])
    every = F.sum("n").over(Window.partitionBy())  # one row a range
    return rows.select("range", "n", F.when(every > 0, 100 * F.col("n") / every).otherwise(0.0).alias("percentage"))
