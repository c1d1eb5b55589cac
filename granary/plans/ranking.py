"""Queries of orders, pages and top lists, and of the scores they sort by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scores as S
from granary.plans.registry import query, table


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def longest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by a metric."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 30")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later page in a total order (T1, T6, SC1)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(30).limit(10)


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderpriority, o_orderdate, o_orderkey LIMIT 25""")
def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sort keys, nulls last."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.orderBy(F.desc_nulls_last("o_totalprice"), "o_orderpriority", "o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@query("""SELECT doc_id, source, n_chars, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5""")
def top_documents_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top five of each source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("""WITH m AS (SELECT max(ts) AS t FROM events), e AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS marks FROM events, m WHERE ts >= t - INTERVAL 7 DAYS GROUP BY 1)
SELECT user_id, views + 2 * marks AS score FROM e ORDER BY score DESC, user_id LIMIT 10""")
def trending_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and bookmarks of the last week (T5, M-19, SK18)."""
    e = table(spark, sf_dir, "events")
    newest = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    n = e.where(F.col("ts") >= newest - F.expr("INTERVAL 7 DAYS")).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("marks"))
    return n.select("user_id", S.trending(F.col("views"), F.col("marks")).alias("score")).orderBy(F.desc("score"), "user_id").limit(10)


_AGE = "date_diff('second', o_orderdate, TIMESTAMP '2001-09-01') / 86400.0"


@query(f"""WITH a AS (SELECT o_orderkey, {_AGE} AS d, o_orderpriority AS p FROM orders)
SELECT o_orderkey, round(CASE WHEN substr(p, 1, 1) = '1' THEN least(s + 0.1, 1.0) WHEN substr(p, 1, 1) = '2' AND d > 365 THEN s * 0.8 ELSE s END, 6) AS recency FROM (
SELECT *, CASE WHEN d < 30 THEN 1.0 WHEN d < 90 THEN 0.9 WHEN d < 180 THEN 0.8 WHEN d < 365 THEN 0.7 WHEN d < 730 THEN 0.6 WHEN d < 1095 THEN 0.5 WHEN d < 1825 THEN 0.4 ELSE 0.3 END AS s FROM a)""")
def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The age ladder with changes by type (D-7)."""
    p = F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "article").when(p == "2", "documentation").otherwise("video")
    as_of = F.lit("2001-09-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.recency(F.col("o_orderdate"), kind, as_of), 6).alias("recency"))


@query("""WITH s AS (SELECT event_id, value / 100.0 AS v FROM events), t AS (SELECT *, CASE WHEN v >= 0.7 THEN 'approved' WHEN v >= 0.5 THEN 'review_high' WHEN v >= 0.3 THEN 'review_low' ELSE 'rejected' END AS tier FROM s)
SELECT event_id, tier, CAST(least(10, CASE tier WHEN 'review_high' THEN 7 WHEN 'review_low' THEN 3 ELSE 5 END + least(3, floor(v * 3))) AS INT) AS priority, CAST(CASE WHEN v >= 0.9 THEN 9 WHEN v >= 0.8 THEN 7 WHEN v >= 0.7 THEN 5 ELSE 3 END AS INT) AS article_priority FROM t""")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers and priorities of scores (M-9, M-11, M-12)."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("v"))
    e = e.withColumn("tier", S.route(F.col("v")))
    level = F.when(F.col("tier") == "review_high", "high").when(F.col("tier") == "review_low", "low").otherwise("medium")
    return e.select("event_id", "tier", S.priority(level, F.col("v")).cast("int").alias("priority"), S.article_priority(F.col("v")).cast("int").alias("article_priority"))


@query("""WITH s AS (SELECT event_id, value / 100.0 AS raw, (value / 100.0::DOUBLE) * 0.9::DOUBLE AS model, (user_id % 10) / 10.0::DOUBLE AS other FROM events),
b AS (SELECT event_id, CASE WHEN raw > 0.98 OR raw < 0.02 THEN 0.7 WHEN raw > 0.8 OR raw < 0.2 THEN 0.65 ELSE 0.6 END::DOUBLE AS w, model, other FROM s)
SELECT event_id, round(model * w + other * (1 - w), 9) AS blended, round((model * w + other * (1 - w)) * 0.65::DOUBLE + other * 0.35::DOUBLE, 9) AS final FROM b""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores blended by confidence, then with quality by type (M-7, M-8)."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("raw"), ((F.col("value") / 100.0) * 0.9).alias("model"), ((F.col("user_id") % 10) / 10.0).alias("other"))
    both = S.blend(F.col("raw"), F.col("model"), F.col("other"))
    return e.select("event_id", F.round(both, 9).alias("blended"), F.round(S.final_score(both, F.col("other"), F.lit("repository")), 9).alias("final"))


@query("""WITH c AS (SELECT conv_id, count(*) AS replies, sum(length(text)) AS chars, count(DISTINCT role) AS roles FROM conversations GROUP BY 1)
SELECT conv_id, round(least(1.0, chars / 1000.0) * 0.3 + least(1.0, replies / 20.0) * 0.4 + least(1.0, roles / 10.0) * 0.3, 2) AS engagement FROM c""")
def engagement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped components of engagement (M-14)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("replies"), F.sum(F.length("text")).alias("chars"), F.count_distinct("role").alias("roles"))
    return c.select("conv_id", S.capped([(F.col("chars"), 1000.0, 0.3), (F.col("replies"), 20.0, 0.4), (F.col("roles"), 10.0, 0.3)]).alias("engagement"))


@query("""SELECT doc_id, round(least(1.0, 0.2 + CASE WHEN length(text) > 200 THEN 0.3 ELSE 0 END + 0.15 + CASE WHEN coalesce(quality, 0) = 1 THEN 0.2 ELSE 0 END), 6) AS completeness FROM documents LEFT JOIN labels USING (doc_id)""")
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for the parts a documentation page should have (M-1)."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = {"title": F.lit("t"), "content": F.col("text"), "version": F.col("lang"), "official": F.when(F.col("quality") == 1, "yes")}
    return d.select("doc_id", F.round(S.completeness(F.lit("documentation"), parts), 6).alias("completeness"))
