"""Queries of buckets and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import buckets as B
from granary.plans.registry import query, table


@query("""WITH c AS (SELECT source, lang, count(*) AS doc_count FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_count DESC, lang) AS rank FROM c),
s AS (SELECT source, count(*) AS total FROM documents GROUP BY 1 ORDER BY total DESC, source LIMIT 10)
SELECT source, total, lang, doc_count, CAST(rank AS INT) AS rank FROM r JOIN s USING (source) WHERE rank <= 3""")
def sources_top_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest sources, each with its three most frequent languages."""
    d = table(spark, sf_dir, "documents")
    best = B.terms(d, "source").select(F.col("key").alias("source"), F.col("doc_count").alias("total"))
    per = B.top_per_parent(d, ["source"], "lang", 3)
    return per.join(F.broadcast(best), "source").select("source", "total", F.col("key").alias("lang"), "doc_count", "rank")  # ten rows


@query("SELECT event_type AS key, count(*) AS doc_count, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def terms_with_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric in each bucket."""
    return B.terms(table(spark, sf_dir, "events"), "event_type", metrics=[F.round(F.avg("value"), 6).alias("mean")])


@query("SELECT l_returnflag AS key, count(*) AS doc_count FROM lineitem GROUP BY 1")
def nested_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, not documents, are counted in a nested array."""
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag")).alias("items"))
    return B.terms(nested, "items.l_returnflag", None)


@query("SELECT flag AS key, count(DISTINCT l_orderkey) AS doc_count FROM (SELECT l_orderkey, l_returnflag AS flag FROM lineitem) GROUP BY 1")
def multi_valued_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document counts once for each distinct value of a multi-valued field (A1)."""
    multi = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return B.terms(multi, "flags", None)


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate) AS bucket, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(bucket)::TIMESTAMP FROM c), (SELECT max(bucket)::TIMESTAMP FROM c), INTERVAL 1 MONTH)) AS bucket)
SELECT spine.bucket::TIMESTAMP AS bucket, coalesce(n, 0) AS doc_count, round(s, 2) AS total FROM spine LEFT JOIN c ON c.bucket = spine.bucket""")
def calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with gaps filled in (A4)."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return B.calendar(o, "o_orderdate", "month", [F.round(F.sum("o_totalprice"), 2).alias("total")])


@query("""WITH c AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(bucket)::TIMESTAMP FROM c), (SELECT max(bucket)::TIMESTAMP FROM c), INTERVAL 1 DAY)) AS bucket)
SELECT spine.bucket::TIMESTAMP AS bucket, coalesce(n, 0) AS doc_count FROM spine LEFT JOIN c ON c.bucket = spine.bucket""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with gaps filled in."""
    return B.calendar(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts", "day")


@query("""SELECT 'count' AS key, round(count(o_totalprice)::DOUBLE, 4) AS value FROM orders UNION ALL SELECT 'min', round(min(o_totalprice), 4) FROM orders
UNION ALL SELECT 'max', round(max(o_totalprice), 4) FROM orders UNION ALL SELECT 'avg', round(avg(o_totalprice), 4) FROM orders UNION ALL SELECT 'sum', round(sum(o_totalprice), 4) FROM orders""")
def stats_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five statistics as buckets."""
    return B.stats_rows(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum FROM events GROUP BY 1""")
def stats_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each group."""
    s = B.stats(table(spark, sf_dir, "events"), "value", ["event_type"])
    return s.select("event_type", "count", "min", "max", F.round("avg", 6).alias("avg"), F.round("sum", 4).alias("sum"))


@query("""SELECT 'p' || p AS key, round(quantile_cont(l_extendedprice, p / 100.0), 4) AS value FROM lineitem, (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS p) GROUP BY p""".replace("quantile_cont(l_extendedprice, p / 100.0)", "list_extract(q, i)").replace("FROM lineitem, (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS p) GROUP BY p", "FROM (SELECT quantile_cont(l_extendedprice, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM lineitem), (SELECT unnest([1, 5, 25, 50, 75, 95, 99]) AS p, unnest([1, 2, 3, 4, 5, 6, 7]) AS i)"))
def percentile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles as buckets."""
    return B.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("key", F.round("value", 4).alias("value"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(l_tax) AS taxed, round(sum(coalesce(l_discount, 0)), 4) AS discounts FROM lineitem")
def exact_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts, a value count and a sum with a default for missing values."""
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count("l_tax").alias("taxed"), F.round(F.sum(F.coalesce("l_discount", F.lit(0.0))), 4).alias("discounts"))


@query()
def sketched_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts by sketch, within about one percent."""
    return B.cardinality(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("""SELECT 'low' AS key, count(*) FILTER (l_discount < 0.03) AS doc_count FROM lineitem UNION ALL SELECT 'medium', count(*) FILTER (l_discount >= 0.03 AND l_discount < 0.07) FROM lineitem
UNION ALL SELECT 'high', count(*) FILTER (l_discount >= 0.07 AND l_discount < 0.1) FROM lineitem""")
def range_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named ranges with the upper bound outside."""
    return B.ranges(table(spark, sf_dir, "lineitem"), "l_discount", [("low", None, 0.03), ("medium", 0.03, 0.07), ("high", 0.07, 0.1)])


@query("""SELECT event_type, count(*) AS doc_count, count(*) FILTER (value >= 80) AS high, count(*) FILTER (value < 20) AS low, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under conditions in one pass."""
    e = table(spark, sf_dir, "events")
    return B.filter_counts(e, ["event_type"], {"high": F.col("value") >= 80, "low": F.col("value") < 20}, [F.round(F.avg("value"), 6).alias("mean")])


@query("""SELECT 'lang' AS field, lang AS key, count(*) AS doc_count FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of several fields from one scan."""
    return B.several(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS click, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS purchase,
sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS view FROM events GROUP BY 1""".replace("sum(", "round(sum(").replace(" END)", " END), 4)"))
def wide_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a day and a column for each series, missing ones 0."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    names = ["click", "purchase", "view"]
    out = B.wide_series(e, "day", "event_type", "value", names)
    return out.select("day", *(F.round(n, 4).alias(n) for n in names))


@query("""SELECT CASE lang WHEN 'en' THEN 'Germanic' WHEN 'de' THEN 'Germanic' WHEN 'fr' THEN 'Romance' WHEN 'es' THEN 'Romance' ELSE lang END AS key, CAST(count(*) AS BIGINT) AS doc_count FROM documents GROUP BY 1""")
def remapped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets renamed and merged."""
    return B.merged_buckets(B.terms(table(spark, sf_dir, "documents"), "lang", None), {"EN": "Germanic", "de": "Germanic", "FR": "Romance", "es": "Romance"})


@query("""WITH c AS (SELECT year(o_orderdate) AS year, o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY ALL)
SELECT year, key, doc_count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY doc_count DESC, key) AS rank FROM c) WHERE rank <= 2""")
def yearly_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels: the largest terms of each year."""
    return B.top_per_parent(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("long")), ["year"], "o_orderpriority", 2)


@query("""SELECT event_id, CASE WHEN event_id * 10000000000 > 1000000000000 THEN strftime(make_timestamp(CAST(event_id * 10000000000 * 1000 AS BIGINT)), '%Y-%m-%d') ELSE CAST(event_id * 10000000000 AS VARCHAR) END AS label FROM events""")
def bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket keys as text; large numbers are dates (P20)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", B.bucket_key(F.col("event_id") * F.lit(10000000000)).alias("label"))


@query("""WITH t AS (SELECT event_type, count(*) AS n, avg(value) AS m, count(*) FILTER (value > 50) * 1.0 / count(*) AS h FROM events GROUP BY 1)
SELECT event_type, n, round(least(24.0, greatest(1.0, CASE WHEN n > 150 AND h > 0.5 THEN 6 * 0.75 WHEN n < 100 THEN 6 * 1.5 ELSE 6.0 END)), 4) AS hours FROM t""")
def fetch_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's next interval by its volume and quality, within bounds (A25, ST8)."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("h"))
    hours = F.when((F.col("n") > 150) & (F.col("h") > 0.5), 6 * 0.75).when(F.col("n") < 100, 6 * 1.5).otherwise(6.0)
    return e.select("event_type", "n", F.round(F.least(F.lit(24.0), F.greatest(F.lit(1.0), hours)), 4).alias("hours"))
