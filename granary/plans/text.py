"""Queries of text extraction over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as E
from granary.functions import text as T
from granary.plans.registry import query, table
from granary.sources import readers as R


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' +', ' ', 'g'))) AS normal FROM documents")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, letters and digits only, single spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalised(F.col("text"))).alias("normal"))


_FP = "CASE WHEN source IN ('src1', 'src2', 'src3') THEN md5(source || '|' || doc_id) ELSE md5(lower(trim(regexp_extract(text, '^([^.\\n]*)', 1))) || '|' || source || '|' || '2020-01-01' || '|' || lower(lang)) END"


@query(f"SELECT doc_id, {_FP} AS fingerprint FROM documents")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source id, else by title, source, date and person."""
    d = table(spark, sf_dir, "documents")
    f = T.fingerprint(F.col("source"), F.col("doc_id").cast("string"), T.title_of(F.col("text")), F.lit("2020-01-01T00:00:00"), F.col("lang"), ["src1", "src2", "src3"])
    return d.select("doc_id", f.alias("fingerprint"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(https?://[^\\s<>"{}|\\\\^`\\[\\]]+)', 1))) AS urls, len(list_distinct(regexp_extract_all(html, '(10\\.[0-9]{4,}/[-._;()/:0-9A-Za-z_]+)', 1))) AS dois FROM pages""")
def page_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses and document identifiers in a text."""
    p = table(spark, sf_dir, "pages").select("page_id", T.identifiers([F.col("html")]).alias("i"))
    return p.select("page_id", F.size("i.urls").cast("long").alias("urls"), F.size("i.dois").cast("long").alias("dois"))


@query("""WITH s AS (SELECT doc_id, unnest([{'c': 'terms', 's': (length(lower(text)) - length(replace(lower(text), 'licens', ''))) // 6 + (length(lower(text)) - length(replace(lower(text), 'version', ''))) // 7}, {'c': 'articles', 's': (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3}]) AS x FROM documents)
SELECT doc_id, x.c AS category, CAST(x.s AS INT) AS score FROM s WHERE x.s > 0""")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword counts of each category."""
    d = table(spark, sf_dir, "documents")
    s = T.category_scores(F.col("text"), {"terms": ["licens", "version"], "articles": ["the"]})
    return d.select("doc_id", F.explode(s).alias("s")).select("doc_id", "s.category", "s.score")


@query("""WITH q AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(replace(text, '.', '?'), '([^.!?]*\\?)', 1), lambda s: trim(s)), lambda s: length(s) > 10) AS qs FROM conversations) SELECT conv_id, turn, len(qs[1:20]) AS n FROM q WHERE len(qs) > 0""")
def questions_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that end in a question mark, which those of the test texts get here."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.questions(F.replace("text", F.lit("."), F.lit("?")))).cast("long").alias("n"))
    return c.where("n > 0")


@query("""SELECT doc_id, list_filter(['license', 'version', 'the', 'und'], lambda t: regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || t || '($|[^\\p{L}\\p{N}_])')) AS found FROM documents""")
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary terms as whole words."""
    return table(spark, sf_dir, "documents").select("doc_id", T.mentions(F.col("text"), ["license", "version", "the", "und"]).alias("found"))


@query("""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents) SELECT doc_id, n AS n_words, CAST(n // 200 AS INT) AS minutes FROM w""")
def reading_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and minutes to read."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))
    return d.select("doc_id", "n_words", T.reading_minutes(F.col("n_words")).alias("minutes"))


@query("""WITH t AS (SELECT conv_id, arg_min(text, turn) AS first, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1), f AS (SELECT conv_id, contains(lower(first), '?') OR regexp_matches(lower(first), '^(how|what|why|when|where|which|who|can|could|is|are|does|do|should)\\b') AS q,
contains(lower(first), 'announcement') AS a, regexp_matches(lower(first), 'help|issue|problem|error|stuck|advice') AS h, regexp_matches(lower(body), 'solution|solved') AS s FROM t)
SELECT conv_id, CASE WHEN a THEN 'announcement' WHEN q AND s THEN 'solved_question' WHEN q THEN 'open_question' WHEN h THEN 'help_request' ELSE 'general_discussion' END AS kind FROM f""")
def thread_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each discussion."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    c = c.select("conv_id", F.get("t", F.lit(0))["text"].alias("first"), F.transform("t", lambda x: x["text"]).alias("bodies"))
    facts = E.thread_facts(F.col("first"), F.lit(""), F.col("bodies"), F.lit(False), [], [])
    return c.select("conv_id", facts.alias("f")).select("conv_id", E.thread_type(F.col("f")).alias("kind"))


@query("""WITH p AS (SELECT conv_id, role, count(*) AS posts, sum(length(text)) AS chars, min(turn) = 0 AS opened FROM conversations GROUP BY ALL) SELECT conv_id, role, posts, CAST(chars AS BIGINT) AS chars, opened, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY posts DESC, chars DESC, role) AS INT) AS rank FROM p""")
def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each thread by posts."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("posts"), F.sum(F.length("text")).cast("long").alias("chars"), (F.min("turn") == 0).alias("opened"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("posts"), F.desc("chars"), "role")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("""SELECT conv_id, count(*) AS posts, count(DISTINCT role) AS authors, CAST(floor(avg(length(text))) AS BIGINT) AS mean_length, arg_max(turn, {'l': length(text), 't': -turn}) AS longest FROM conversations GROUP BY 1""")
def thread_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, authors, mean length and the longest post, the first of several."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("role").alias("authors"), F.floor(F.avg(F.length("text"))).cast("long").alias("mean_length"), F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("longest"))


@query()
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, headings, code, links and text of HTML pages, however broken (SC20, SC21)."""
    return R.html_pages(table(spark, sf_dir, "pages"))


@query("""WITH t AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]+') AS s FROM documents) SELECT doc_id, len(list_filter(list_transform(s, lambda x: trim(x, ' ')), lambda x: length(x) > 0)) AS n FROM t""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)apache.{0,20}2\\.0') THEN 'Apache-2.0' WHEN regexp_matches(text, '(?i)\\bmit license\\b') THEN 'MIT' WHEN regexp_matches(text, '(?i)\\bgpl.{0,3}3|general public license.{0,20}3') THEN 'GPL-3.0' WHEN regexp_matches(text, '(?i)\\bbsd\\b') THEN 'BSD-3-Clause' WHEN regexp_matches(text, '(?i)\\bcc[- ]by\\b') THEN 'CC-BY' END AS license FROM documents""")
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first licence pattern that a text has."""
    return table(spark, sf_dir, "documents").select("doc_id", E.readme_facts(F.col("text"))["license"].alias("license"))
