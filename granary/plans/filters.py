"""Queries of the filter algebra, over orders, line items, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import filters as P
from granary.plans.registry import query, table


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000
 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND NOT o_orderpriority = '5-LOW'""")
def filter_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """must, must_not, terms and ranges."""
    o = table(spark, sf_dir, "orders")
    must = [P.in_values(o, "o_orderstatus", ["F", "O"]), P.in_range("o_totalprice", gte=1000, lte=200000), P.in_range(F.col("o_orderdate"), gte="1996-01-01", lt="1998-01-01")]
    return o.where(P.boolean(must=must, must_not=[P.is_value(o, "o_orderpriority", "5-LOW")])).select("o_orderkey", "o_orderpriority")


@query("""SELECT event_id FROM events WHERE (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) >= 2""")
def filter_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least two of three clauses."""
    e = table(spark, sf_dir, "events")
    return e.where(P.boolean(should=[F.col("event_type") == "click", F.col("value") > 50, F.col("user_id") % 2 == 0], at_least=2)).select("event_id")


@query("""WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id FROM events, m WHERE ts >= date_trunc('day', t - INTERVAL 7 DAYS)""")
def filter_date_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven whole days before the newest event."""
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts")).first()[0]
    return e.where(P.since("ts", F.lit(newest).cast("timestamp_ntz"), 7, whole_days=True)).select("event_id")


@query("""SELECT o_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R') ON l_orderkey = o_orderkey""")
def filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which some nested line item satisfies both conditions."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("items"))
    return table(spark, sf_dir, "orders").join(li, "o_orderkey").where(P.nested_any("items", lambda i: (i["l_quantity"] > 45) & (i["l_returnflag"] == "R"))).select("o_orderkey")


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL""")
def filter_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(~P.present(d, "quality")).select("doc_id")


@query("""SELECT p_partkey FROM part WHERE p_name LIKE 'small%' AND regexp_full_match(p_brand, 'Brand#[0-9]+') AND contains(lower(p_type), 'e')""")
def filter_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix, whole-string pattern and substring."""
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_name").startswith("small") & F.col("p_brand").rlike("^Brand#[0-9]+$") & P.relevant(F.col("p_type"), ["e"])).select("p_partkey")


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS ws FROM documents)
SELECT doc_id FROM t WHERE len(list_intersect(ws, ['the', 'that', 'with', 'from', 'this', 'was', 'of', 'and', 'is', 'zzz'])) >= 7""")
def filter_token_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least 70 percent of the query's tokens."""
    return table(spark, sf_dir, "documents").where(P.token_share(F.col("text"), "the that with from this was of and is zzz", 0.7)).select("doc_id")


@query("""SELECT doc_id, (CASE WHEN contains(lower(text), 'licens') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'the ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), '|') THEN 1 ELSE 0 END) >= 2 AS is_relevant FROM documents""")
def relevance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword count against a threshold."""
    return table(spark, sf_dir, "documents").select("doc_id", P.relevant(F.col("text"), ["Licens", "the ", "|"], 2).alias("is_relevant"))
