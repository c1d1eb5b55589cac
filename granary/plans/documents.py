"""Queries of the document pipeline: normalised rows, routing, keyed tables, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scores as S
from granary.functions import text as T
from granary.operators import normalize as N
from granary.operators import review as V
from granary.plans.registry import query, table
from granary.streaming import ingest as I


@query("""SELECT doc_id AS id, source, regexp_extract(text, '^([^.\\n]*)', 1) AS title, substr(text, 1, 500) AS abstract, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS approval_status FROM documents LEFT JOIN labels USING (doc_id)""".replace("regexp_extract(text, '^([^.\\n]*)', 1)", "trim(regexp_extract(text, '^([^.\\n]*)', 1))"))
def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the content table."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending")
    return d.select(F.col("doc_id").alias("id"), "source", T.title_of(F.col("text")).alias("title"), F.substring("text", 1, 500).alias("abstract"), status.alias("approval_status"))


@query("""WITH t AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn) AS l FROM conversations GROUP BY 1) SELECT conv_id AS id, 'article' AS content_type, substr(l[1].x, 1, 500) AS abstract, len(l) - 1 AS reply_count FROM t""".replace("'article'", "'discussion'"))
def discussion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads as rows of the content table (P6, SC32)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("posts"))
    out = N.discussions(c.select(F.col("conv_id").alias("topic_id"), F.lit("").alias("title"), F.get("posts", F.lit(0))["text"].alias("summary"), F.get("posts", F.lit(0))["role"].alias("poster"), F.transform("posts", lambda p: p["role"]).alias("participants"), (F.size("posts") - 1).cast("long").alias("reply_count")))
    return out.select("id", "content_type", "abstract", "reply_count")


@query("""WITH e AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT c_custkey AS id, coalesce(n, 0) AS view_count FROM customer LEFT JOIN e ON id = c_custkey""")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter with one more for each event (SK7, SK17)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("view_count"))
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"))
    return V.add_counts(c, e, "view_count")


@query("""SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT -doc_id, 'new' FROM documents WHERE lang = 'de' AND doc_id > 0""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an upsert by key (SK1-SK3)."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    new = d.where("lang = 'de'").select("id", F.lit("new").alias("source"))
    return V.upsert(d.select("id", "source"), new.unionByName(new.where("id > 0").withColumn("id", -F.col("id"))))


@query("""SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN quality IS NOT NULL THEN 'r1' END AS reviewer_id FROM documents LEFT JOIN labels USING (doc_id)""")
def reviewed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after actions (SK8-SK11)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    queue = d.select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reviewer_id"), F.lit(None).cast("timestamp_ntz").alias("reviewed_date"))
    actions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("action"), F.lit("r1").alias("reviewer"))
    return V.review(queue, actions, F.lit("2024-01-01").cast("timestamp_ntz")).select("id", "status", "reviewer_id")


@query("""WITH s AS (SELECT event_id, value / 100.0 AS v FROM events) SELECT CASE WHEN v >= 0.7 THEN 'approved' WHEN v >= 0.5 THEN 'review_high' WHEN v >= 0.3 THEN 'review_low' ELSE 'rejected' END AS tier, count(*) AS n FROM s GROUP BY 1""")
def routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each tier gets (A38, M-9)."""
    e = table(spark, sf_dir, "events").select(S.route(F.col("value") / 100.0).alias("tier"))
    return e.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows (ST10)."""
    out = I.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events with gaps under six hours (ST10)."""
    out = I.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts + to_days(i))::TIMESTAMP AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, -1]) AS i) GROUP BY 1, 2""")
def sliding_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day windows every day (ST10)."""
    out = I.sliding(table(spark, sf_dir, "events"), "ts", "2 days", "1 day", ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
