"""Queries of joins that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import linking as K
from granary.plans.registry import query, table


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the first (W8, U6, SC14)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return K.first_seen(d, ["h"], ["doc_id"]).select("doc_id", "source")


@query("""WITH new AS (SELECT doc_id AS id, regexp_extract(text, '^([^.\\n]*)', 1) AS title, md5(text) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), old AS (SELECT doc_id AS id, regexp_extract(text, '^([^.\\n]*)', 1) AS title, md5(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT n.id, coalesce((SELECT min(id) FROM old o WHERE o.h = n.h), (SELECT min(id) FROM old o WHERE trim(o.title) = trim(n.title))) AS duplicate_of FROM new n""")
def duplicate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents probed against labelled ones, by contents and then by title."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), T.title_of(F.col("text")).alias("title"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    found = K.duplicate_cascade(d.join(known, "id", "left_anti"), d.join(known, "id", "left_semi"), [["h"], ["title"]])
    return found.select("id", "duplicate_of")


@query("""WITH d AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(regexp_extract(text, '^([^.\\n]*)', 1)), '[\\p{L}\\p{N}_]+'))) AS t FROM documents), k AS (SELECT * FROM d WHERE len(t) > 0), c AS (SELECT t, min(doc_id) AS class_id FROM k GROUP BY 1)
SELECT doc_id, class_id, (SELECT count(*) FROM k b WHERE b.doc_id <> k.doc_id AND len(list_intersect(k.t, b.t)) / len(list_distinct(list_concat(k.t, b.t))) >= 0.8 - 1e-12) AS links FROM k JOIN c USING (t)""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of Jaccard similarity 0.8 and more, by prefix filtering (J5, J8, X3): equal ones are a class, and each row has its number of links."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"))
    return K.similar_titles(d, "doc_id", "title").withColumnRenamed("id", "doc_id")


@query("""SELECT o_orderkey, count(l_partkey) AS total, count(*) FILTER (p_size < 20) AS hits, round(count(*) FILTER (p_size < 20) / count(l_partkey), 6) AS ratio FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey, p_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def reference_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references are in a known set."""
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("refs"))
    known = table(spark, sf_dir, "part").where("p_size < 20")
    out = K.overlap(refs, "o_orderkey", "refs", known, "p_partkey")
    return out.select(F.col("id").alias("o_orderkey"), "total", "hits", F.round("ratio", 6).alias("ratio"))


@query("""SELECT l_orderkey, string_agg(l_partkey || ':' || coalesce(p_brand, '-'), ',' ORDER BY l_linenumber, l_partkey) AS refs FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON p_partkey = l_partkey GROUP BY 1""")
def expanded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids with the metadata of those known, in order (J2, SC11, SC12)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    li = li.select("l_orderkey", F.transform("l", lambda x: x["l_partkey"]).alias("refs"))
    out = K.expand_ids(li, "l_orderkey", "refs", table(spark, sf_dir, "part").where("p_size < 30"), "p_partkey", ["p_brand"])
    return out.select("l_orderkey", F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["id"], F.coalesce(r["p_brand"], F.lit("-")))), ",").alias("refs"))


@query("""SELECT source, count(*) AS merged, max(n_chars) AS n_chars, md5(arg_max(text, {'l': length(text), 'd': -doc_id})) AS longest, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs, CAST(sum(doc_id) AS BIGINT) AS ids, arg_min(lang, doc_id) AS first_lang FROM documents GROUP BY 1""")
def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups merged by maxima, longest text, unions and first values (AR-1, U5)."""
    d = table(spark, sf_dir, "documents").withColumn("langs", F.array("lang"))
    out = K.merge_duplicates(d, "source", "doc_id", greatest=["n_chars"], longest=["text"], united=["langs"], summed=["doc_id"], first=["lang"])
    return out.select("source", "merged", "n_chars", F.md5("text").alias("longest"), F.array_join("langs", ",").alias("langs"), F.col("doc_id").alias("ids"), F.col("lang").alias("first_lang"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return K.not_known(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


_NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {_NORMAL.format("text")} AS t FROM documents), n AS (SELECT item_id, {_NORMAL.format("regexp_extract(text, '^([^.]*)', 1)")} AS n FROM benchmark)
SELECT doc_id, item_id FROM t JOIN n ON contains(' ' || t || ' ', ' ' || n || ' ') WHERE len(string_split(n, ' ')) > 2""")
def named_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts name which titles."""
    titles = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "^([^.]*)", 1).alias("title"))
    out = K.named_in(table(spark, sf_dir, "documents"), "doc_id", "text", titles, "item_id", "title")
    return out.select(F.col("text_id").alias("doc_id"), F.col("title_id").alias("item_id"))
