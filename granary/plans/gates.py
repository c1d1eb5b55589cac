"""Queries of the remaining predicates, gates, scores and display maps, over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scores as S
from granary.functions import text as T
from granary.operators import buckets as B
from granary.operators import filters as P
from granary.plans.registry import query, table


@query("""SELECT event_id, true AS every, false AS none, event_type = 'click' AS kind, list_contains([user_id % 3, 7], 1) AS member, (user_id % 2 = 0) OR (user_id % 5 = 0) AS cited, (CAST(user_id % 2 = 0 AS INT) + CAST(user_id % 3 = 0 AS INT)) >= 2 AS structured FROM events""")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, none, a value, membership, nested fields, lists that have an element, indicator paths."""
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").withColumn("tags", F.array(u % 3, F.lit(7).cast("long"))).withColumn("authors", F.array(F.struct(F.col("event_type").alias("name"))))
    empty = F.array().cast("array<long>")
    e = e.withColumn("cited_by", F.when(u % 2 == 0, F.array(u)).otherwise(empty)).withColumn("references", F.when(u % 5 == 0, F.array(u)).otherwise(empty))
    paths = F.array_compact(F.array(F.when(u % 2 == 0, "R/"), F.when(u % 3 == 0, "inst/sql"), F.lit("README.md")))
    return e.select("event_id", P.everything().alias("every"), P.nothing().alias("none"), P.is_value(e, "authors.name", "click").alias("kind"), P.is_value(e, "tags", 1).alias("member"), P.has_citations("cited_by", "references").alias("cited"), P.has_structure(paths, ["R/", "inst/sql", "DESCRIPTION"]).alias("structured"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1999-01-31' AND o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 4 YEAR")
def filter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date bounds by either name, and a preset's lower bound (F6, F33, D-8)."""
    low, high = P.date_bounds({"publishedAfter": "1990-01-01", "date_from": "1996-03-01", "publishedBefore": "1999-01-31"})
    as_of = F.lit("2001-01-01").cast("timestamp_ntz")
    since = as_of
    for _ in range(4):
        since = P.preset_start("year", since)
    o = table(spark, sf_dir, "orders")
    return o.where(P.in_range(F.col("o_orderdate"), gte=low, lte=high) & (F.col("o_orderdate") >= since)).select("o_orderkey")


@query("""SELECT event_id FROM events WHERE CASE event_type WHEN 'click' THEN value >= 30 WHEN 'view' THEN value >= 10 WHEN 'purchase' THEN value >= 50 ELSE true END AND event_type IS NOT NULL AND (event_type <> 'click' OR user_id % 2 = 0)""")
def gated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least amounts by type, and required fields with a keyword for one of them."""
    kind = F.when(F.col("event_type") == "click", "video").when(F.col("event_type") == "view", "repository").when(F.col("event_type") == "purchase", "documentation").otherwise("other")
    amounts = {"duration": F.col("value"), "readme_length": F.col("value"), "content_length": F.col("value")}
    named = F.when(F.col("user_id") % 2 == 0, "about cohorts").otherwise("something else")
    e = table(spark, sf_dir, "events")
    return e.where(P.passes_gate(kind, amounts) & F.col("event_type").isNotNull() & ((kind != "video") | P.relevant(named, ["cohort"]))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_totalprice <= 90000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue by status and score range, all sources."""
    o = table(spark, sf_dir, "orders")
    rows = o.where(P.all_of([P.is_value(o, "o_orderstatus", "O"), P.in_range("o_totalprice", gte=1000, lte=90000)]))
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey")


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events WHERE CAST(ts AS VARCHAR) > '2024-01-03'")
def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a time given as text."""
    e = table(spark, sf_dir, "events").where(F.col("ts") > F.lit("2024-01-03").cast("timestamp_ntz"))
    return e.select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH e AS (SELECT event_id, event_type AS t, value / 100.0 AS v, (user_id % 10) / 10.0 AS u FROM events)
SELECT event_id, round(greatest(0.0, least(1.0, CASE t WHEN 'click' THEN 0.5 * v + 0.5 * u WHEN 'view' THEN 0.8 * v + 0.25 * u ELSE 0.25 * v + 0.25 * u END)), 9) AS weighted,
round(CASE WHEN v > 0.5 THEN least(1.0, v * CASE t WHEN 'click' THEN 0.9 ELSE 1.0 END * 1.2) ELSE v * CASE t WHEN 'click' THEN 0.9 ELSE 1.0 END END, 9) AS adjusted,
CASE WHEN v >= 0.64 THEN 'approved' WHEN v >= 0.355 THEN 'review_high' WHEN v >= 0.07 THEN CASE WHEN u < 0.5 THEN 'review_high' ELSE 'review_low' END ELSE 'rejected' END AS tier, v >= 0.7 OR u >= 0.7 AS approved FROM e""")
def adjusted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by type, boosts, calibrated routing with unknown authors first, and approval by either score (M-4, M-6, M-10)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("t"), (F.col("value") / 100.0).alias("v"), ((F.col("user_id") % 10) / 10.0).alias("u"))
    v, u = F.col("v"), F.col("u")
    weighted = S.weighted({"quality": v, "age": u}, F.col("t"), {"click": {"quality": 0.5, "age": 0.5}, "view": {"quality": 0.8}})
    boosted = S.adjusted(v, F.when(F.col("t") == "click", 0.9).otherwise(1.0), [(v > 0.5, 1.2)])
    tier = S.review_tier(v, u >= 0.5, 0.64, 0.355, 0.07)
    return e.select("event_id", F.round(weighted, 9).alias("weighted"), F.round(boosted, 9).alias("adjusted"), tier.alias("tier"), S.approves("either", v, u, v).alias("approved"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS v, max(turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, round(n / greatest(v, 1), 9) AS reply_rate, round(t / greatest(v, 1), 9) AS like_rate, CASE WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS depth, conv_id % 7 + 1 >= 6 AS reviewer FROM c""")
def thread_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over views, the depth of a thread, and a role's rank (M-13, M-20, Z20)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("v"), F.max("turn").alias("t"))
    r = S.rates(F.col("v"), F.col("n"), F.col("t"))
    role = F.element_at(F.array(*map(F.lit, S.ROLES)), (F.col("conv_id") % 7 + 1).cast("int"))
    depth = F.when(F.col("n") > 20, "high").when(F.col("n") > 5, "medium").otherwise("low")
    return c.select("conv_id", F.round(r["reply_rate"], 9).alias("reply_rate"), F.round(r["like_rate"], 9).alias("like_rate"), depth.alias("depth"), S.has_role(role, "reviewer").alias("reviewer"))


@query("SELECT lang AS key, count(*) AS doc_count FROM documents GROUP BY 1 ORDER BY 1 LIMIT 3")
def terms_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets in the order of their keys (A2)."""
    return B.terms(table(spark, sf_dir, "documents"), "lang", 3, order="key")


@query("SELECT count(DISTINCT x) AS people, min(t) AS first, max(t) AS last, avg(v) AS mean, count(*) AS hits FROM (SELECT unnest(['u' || user_id, 'v' || user_id % 10]) AS x, epoch_us(ts) // 1000 AS t, round(value) AS v FROM events)")
def corpus_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct people, the range of dates in milliseconds, a mean and the total."""
    e = table(spark, sf_dir, "events").select(F.explode(F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("v"), (F.col("user_id") % 10).cast("string")))).alias("x"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"), F.round("value").alias("v"))
    return e.agg(F.count_distinct("x").alias("people"), F.min("t").alias("first"), F.max("t").alias("last"), F.avg("v").alias("mean"), F.count(F.lit(1)).alias("hits"))


@query("""WITH d AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, avg(n_chars) AS mean, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, langs, round(mean, 6) AS mean, round(labelled * 100.0 / n, 2) AS enriched, CASE WHEN n > 60 THEN 'up' WHEN n < 40 THEN 'down' ELSE 'stable' END AS trend FROM d""")
def source_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's volume, variety, mean, share of enriched rows and trend."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.avg("n_chars").alias("mean"), F.count("quality").alias("labelled"))
    return g.select("source", "n", "langs", F.round("mean", 6).alias("mean"), F.round(F.col("labelled") * 100.0 / F.col("n"), 2).alias("enriched"), F.when(F.col("n") > 60, "up").when(F.col("n") < 40, "down").otherwise("stable").alias("trend"))


@query("""WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY ALL) SELECT date, CAST(year(date) AS INT) AS year, CAST(sum(n) AS BIGINT) AS n, string_agg(k || '=' || n, ',' ORDER BY k) AS categories FROM c GROUP BY 1, 2""")
def category_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by month with a map of categories."""
    c = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("date").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "n"))).alias("l"))
    return g.select("date", F.year("date").alias("year"), "n", F.array_join(F.transform("l", lambda e: F.concat_ws("=", e["k"], e["n"])), ",").alias("categories"))


@query("""WITH g AS (SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS distinct_texts, CAST(sum(n) AS BIGINT) AS processed, round((sum(n) - count(*)) * 100.0 / sum(n), 4) AS duplicate_rate, round(avg(n - 1), 6) AS mean_related FROM g""")
def duplicate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of duplicates and how many each text has."""
    g = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    one = g.agg(F.count(F.lit(1)).alias("distinct_texts"), F.sum("n").alias("processed"), F.avg(F.col("n") - 1).alias("mean_related"))
    return one.select("distinct_texts", "processed", F.round((F.col("processed") - F.col("distinct_texts")) * 100.0 / F.col("processed"), 4).alias("duplicate_rate"), F.round("mean_related", 6).alias("mean_related"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'book' WHEN 'de' THEN 'video' ELSE 'file' END AS icon, CASE WHEN source = 'src1' THEN 'First' WHEN lang = 'en' THEN 'English' ELSE 'Other' END AS label, CASE CASE lang WHEN 'en' THEN 'book' WHEN 'de' THEN 'video' ELSE 'file' END WHEN 'video' THEN 1 WHEN 'book' THEN 2 ELSE 99 END AS priority FROM documents""")
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and icons by source or type with defaults, and an order of types with unknown ones last."""
    icon = F.when(F.col("lang") == "en", "book").when(F.col("lang") == "de", "video").otherwise("file")
    label = F.when(F.col("source") == "src1", "First").when(F.col("lang") == "en", "English").otherwise("Other")
    place = F.array_position(F.array(F.lit("video"), F.lit("book")), icon).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", icon.alias("icon"), label.alias("label"), F.when(place > 0, place).otherwise(99).alias("priority"))


@query("""SELECT doc_id, 'src' || ',' || lang AS flat, len(list_intersect([lang, source], ['en', 'src2'])) > 0 AS overlap, len([lang, source, lang][1:2]) AS two FROM documents""")
def array_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays joined, cut and tested (AR-2, P25)."""
    pair = F.array("lang", "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array(F.lit("src"), F.col("lang")), ",").alias("flat"), F.arrays_overlap(pair, F.array(F.lit("en"), F.lit("src2"))).alias("overlap"), F.size(F.slice(F.array("lang", "source", "lang"), 1, 2)).cast("long").alias("two"))


@query("SELECT doc_id, trim(regexp_extract(text, '^([^.\\n]*)', 1)) || ' ' || substr(text, 1, 500) AS embedded FROM documents")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is embedded: the title and the abstract's beginning (Z59, SK14)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", T.title_of(F.col("text")), F.substring("text", 1, 500)).alias("embedded"))


@query("""WITH r AS (SELECT source, CAST(doc_id AS BIGINT) AS id, 7 AS k, n_chars FROM documents) SELECT source, id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, id) AS i FROM r) WHERE i <= 7""")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's list cut at a fixed length: the largest contributions first."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("i", F.row_number().over(w)).where("i <= 7").select("source", F.col("doc_id").alias("id"), "n_chars")


@query("""WITH e AS (SELECT event_id, event_type, coalesce(nullif(regexp_extract(props, '"([^"]+)":', 1), ''), '-') AS first_key FROM events) SELECT event_type, first_key, count(*) AS n FROM e GROUP BY ALL""")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first key of JSON columns (JS-2)."""
    key = F.coalesce(F.get(F.json_object_keys("props"), F.lit(0)), F.lit("-"))
    return table(spark, sf_dir, "events").groupBy("event_type", key.alias("first_key")).agg(F.count(F.lit(1)).alias("n"))
