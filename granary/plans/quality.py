"""Queries of the quality scores by type, over events, parts, conversations, documents and pages as records of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import quality as Q
from granary.functions import text as T
from granary.plans.registry import query, table

_KINDS = ("article", "video", "repository", "discussion", "documentation")
_KIND_SQL = "list_extract(['article', 'video', 'repository', 'discussion', 'documentation'], CAST(p_partkey % 5 AS INT) + 1)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of the five types: the brand as journal, channel and owner, sizes and prices as counters."""
    return table(spark, sf_dir, "part").withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 5 + 1).cast("int"))).withColumn("place", F.lower(F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, " university journal").otherwise(""))))


_PLACE_SQL = "lower(p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' university journal' ELSE '' END)"


@query(f"""WITH p AS (SELECT p_partkey, {_KIND_SQL} AS kind, {_PLACE_SQL} AS place, p_size AS n, CAST(floor(p_retailprice * 10) AS BIGINT) AS views FROM part)
SELECT p_partkey, kind, round(least(1.0, CASE kind WHEN 'article' THEN 0.5 + CASE WHEN n > 3 THEN 0.1 ELSE 0 END + CASE WHEN n > 10 THEN 0.1 ELSE 0 END + CASE WHEN contains(place, 'journal') THEN 0.1 ELSE 0 END
WHEN 'video' THEN CASE WHEN contains(place, 'brand#11') THEN 1.0 WHEN contains(place, 'university') THEN 0.8 ELSE 0.5 END + CASE WHEN views > 10000 THEN 0.2 WHEN views > 1000 THEN 0.1 ELSE 0 END
WHEN 'repository' THEN CASE WHEN place = 'brand#11' THEN 1.0 WHEN contains(place, 'university') THEN 0.7 ELSE 0.5 END + CASE WHEN n > 100 THEN 0.3 WHEN n > 10 THEN 0.15 ELSE 0 END + CASE WHEN n > 5 THEN 0.1 ELSE 0 END
WHEN 'discussion' THEN 0.5 + CASE WHEN n % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN n > 5 THEN 0.1 ELSE 0 END
ELSE CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.5 END END), 6) AS authority,
round(least(1.0, 0.3 + CASE kind WHEN 'article' THEN CASE WHEN n > 50 THEN 0.4 WHEN n > 10 THEN 0.2 WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN views > 100 THEN 0.2 ELSE 0 END + CASE WHEN n > 10 THEN 0.1 ELSE 0 END
WHEN 'video' THEN CASE WHEN views > 10000 THEN 0.3 WHEN views > 1000 THEN 0.2 WHEN views > 100 THEN 0.1 ELSE 0 END + CASE WHEN views > 0 AND n * 30.0 / views > 0.1 THEN 0.2 WHEN views > 0 AND n * 30.0 / views > 0.05 THEN 0.1 ELSE 0 END
WHEN 'repository' THEN CASE WHEN n > 100 THEN 0.3 WHEN n > 10 THEN 0.15 ELSE 0 END + CASE WHEN n > 50 THEN 0.2 WHEN n > 10 THEN 0.1 ELSE 0 END + CASE WHEN n > 0 THEN 0.05 ELSE 0 END
WHEN 'discussion' THEN CASE WHEN views > 1000 THEN 0.2 WHEN views > 100 THEN 0.1 ELSE 0 END + CASE WHEN n > 10 THEN 0.2 WHEN n > 3 THEN 0.1 ELSE 0 END + CASE WHEN n * 30 > 10 THEN 0.1 ELSE 0 END
ELSE CASE WHEN views > 1000 THEN 0.2 ELSE 0 END + CASE WHEN n > 5 THEN 0.2 ELSE 0 END END), 6) AS engagement FROM p""")
def standing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority and engagement by type (M-2, M-3)."""
    p, n, views = _parts(spark, sf_dir), F.col("p_size"), F.floor(F.col("p_retailprice") * 10)
    fields = {"journal": F.col("place"), "channel": F.col("place"), "owner": F.col("place"), "n_authors": n, "views": views, "stars": n, "forks": n, "likes": n * 30, "citations": n, "bookmarks": n, "answers": n, "open_issues": n, "n_children": n}
    fields |= {"expert_answered": n % 2 == 0, "solved": n % 3 == 0, "official": n % 2 == 0, "source": F.lit("wiki")}
    return p.select("p_partkey", "kind", F.round(Q.authority(F.col("kind"), fields, "brand#11"), 6).alias("authority"), F.round(Q.engagement(F.col("kind"), fields), 6).alias("engagement"))


@query(f"""WITH p AS (SELECT p_partkey, {_KIND_SQL} AS kind, lower(p_brand) AS place, p_size AS n, length(p_type) AS l, CAST(floor(p_retailprice) AS BIGINT) AS views FROM part)
SELECT p_partkey, round(least(1.0, 0.5 + CASE kind WHEN 'article' THEN 0.1 + CASE WHEN n > 3 THEN 0.1 ELSE 0 END + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN l * 40 > 500 THEN 0.1 ELSE 0 END
WHEN 'video' THEN CASE WHEN views > 1000 THEN 0.2 WHEN views > 100 THEN 0.1 ELSE 0 END + CASE WHEN n * 60 > 600 THEN 0.1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN contains(place, 'brand#11') THEN 0.2 ELSE 0 END
WHEN 'repository' THEN CASE WHEN n > 100 THEN 0.2 WHEN n > 10 THEN 0.1 ELSE 0 END + CASE WHEN l * 40 > 1000 THEN 0.15 ELSE 0 END + 0.05 + CASE WHEN place = 'brand#11' THEN 0.2 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.1 ELSE 0 END
WHEN 'discussion' THEN CASE WHEN n % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN n > 5 THEN 0.1 WHEN n > 0 THEN 0.05 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.15 ELSE 0 END
ELSE CASE WHEN n % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN l * 40 > 2000 THEN 0.1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.05 ELSE 0 END END), 6) AS quality FROM p""")
def classifier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's own quality score (M-5)."""
    p, n = _parts(spark, sf_dir), F.col("p_size")
    some, long_ = F.when(n % 2 == 0, "x"), F.repeat("p_type", F.lit(40))
    fields = {"journal": F.col("p_brand"), "channel": F.col("p_brand"), "owner": F.col("p_brand"), "n_authors": n, "n_subjects": n, "doi": some, "abstract": long_, "content": long_, "views": F.floor("p_retailprice"), "stars": n, "duration": n * 60, "transcript": some, "license": F.lit("x"), "last_commit": some, "best_answer": some, "version": some}
    fields |= {"solved": n % 3 == 0, "tutorial": n % 3 == 0, "expert_answered": n % 2 == 0, "official": n % 2 == 0, "answers": n}
    return p.select("p_partkey", F.round(Q.classifier_quality(F.col("kind"), fields, "brand#11"), 6).alias("quality"))


@query("""WITH r AS (SELECT p_partkey, p_size AS n, lower(p_name || CASE WHEN p_size % 2 = 0 THEN ' installation usage license' ELSE '' END || repeat('x', 200 * p_size)) AS t FROM part),
s AS (SELECT p_partkey, CASE WHEN length(t) > 5000 THEN 0.4 WHEN length(t) > 1000 THEN 0.2 ELSE 0 END + CASE WHEN contains(t, 'installation') THEN 0.1 ELSE 0 END + CASE WHEN contains(t, 'usage') OR contains(t, 'example') THEN 0.1 ELSE 0 END + CASE WHEN contains(t, 'license') THEN 0.05 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.1 ELSE 0 END AS d,
CASE WHEN n * 10 < 30 THEN 0.5 WHEN n * 10 < 90 THEN 0.3 WHEN n * 10 < 180 THEN 0.2 WHEN n * 10 < 365 THEN 0.1 ELSE 0 END + CASE WHEN n % 5 <> 0 THEN 0.2 ELSE 0 END + CASE WHEN n * 2 < 50 THEN 0.1 ELSE 0 END AS m,
CASE WHEN n * 4 > 100 THEN 0.3 WHEN n * 4 > 10 THEN 0.15 WHEN n * 4 > 0 THEN 0.05 ELSE 0 END + CASE WHEN n > 50 THEN 0.2 WHEN n > 10 THEN 0.1 WHEN n > 0 THEN 0.05 ELSE 0 END + CASE WHEN n > 10 THEN 0.2 WHEN n > 3 THEN 0.1 WHEN n > 1 THEN 0.05 ELSE 0 END AS c,
CASE WHEN n % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.1 ELSE 0 END + 0.1 AS k FROM r)
SELECT p_partkey, round(d, 6) AS documentation, round(m, 6) AS maintenance, round(c, 6) AS community, round(k, 6) AS code, round(d * 0.3 + m * 0.3 + c * 0.2 + k * 0.2, 6) AS overall FROM s""")
def repository_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation, upkeep, community and code of repositories (M-15)."""
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    readme = F.concat("p_name", F.when(n % 2 == 0, " installation usage license").otherwise(""), F.expr("repeat('x', int(200 * p_size))"))
    fields = {"readme": readme, "wiki": n % 3 == 0, "license": F.when(n % 2 == 0, "MIT"), "days": n * 10, "archived": n % 5 == 0, "open_issues": n * 2, "stars": n * 4, "forks": n, "contributors": n, "structure": n % 3 == 0, "n_topics": F.when(n % 2 == 0, 1).otherwise(0), "language": F.lit("R")}
    q = p.select("p_partkey", Q.repository_quality(fields).alias("q"))
    return q.select("p_partkey", *(F.round(f"q.{c}", 6).alias(c) for c in ("documentation", "maintenance", "community", "code", "overall")))


@query("""WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS v, max(turn) AS t, arg_min(text, turn) AS x FROM conversations GROUP BY 1),
s AS (SELECT conv_id, CASE WHEN v > 1000 THEN 0.3 WHEN v > 100 THEN 0.15 WHEN v > 10 THEN 0.05 ELSE 0 END + CASE WHEN n > 20 THEN 0.3 WHEN n > 5 THEN 0.15 WHEN n > 0 THEN 0.05 ELSE 0 END + CASE WHEN t > 10 THEN 0.2 WHEN t > 3 THEN 0.1 WHEN t > 0 THEN 0.05 ELSE 0 END AS e,
CASE WHEN n * 5 < 7 THEN 0.5 WHEN n * 5 < 30 THEN 0.3 WHEN n * 5 < 90 THEN 0.2 WHEN n * 5 < 365 THEN 0.1 ELSE 0 END AS a, CASE WHEN conv_id % 7 = 0 THEN 0.3 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN length(x) > 200 THEN 0.2 WHEN length(x) > 50 THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(x), 'the') THEN 0.3 ELSE 0 END AS k FROM c)
SELECT conv_id, round(e, 6) AS engagement, a AS activity, round(k, 6) AS content, round(e * 0.4 + a * 0.3 + k * 0.3, 6) AS overall FROM s""")
def discussion_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement, activity and content of threads (M-16)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("v"), F.max("turn").alias("t"), F.min_by("text", "turn").alias("x"))
    fields = {"views": F.col("v"), "replies": F.col("n"), "likes": F.col("t"), "days": F.col("n") * 5, "pinned": F.col("conv_id") % 7 == 0, "n_tags": F.when(F.col("n") % 2 == 0, 1).otherwise(0), "excerpt": F.col("x"), "relevant": F.lower("x").contains("the")}
    q = c.select("conv_id", Q.discussion_quality(fields).alias("q"))
    return q.select("conv_id", *(F.round(f"q.{x}", 6).alias(x) for x in ("engagement", "activity", "content", "overall")))


_FLAGS_SQL = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN 1 ELSE 0 END" for p in Q.INDICATORS.values())


@query(f"""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w, len(string_split(text, chr(10))) - 1 AS h, ({_FLAGS_SQL}) AS f FROM documents)
SELECT doc_id, f AS flags, round(least(1.0, CASE WHEN w > 1000 THEN 0.15 WHEN w > 500 THEN 0.08 ELSE 0 END + 0.05 + CASE WHEN h > 3 THEN 0.1 ELSE 0 END + f / 8.0 * 0.2 + CASE WHEN contains(text, 'license') THEN 0.1 ELSE 0 END + CASE doc_id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.08 ELSE 0 END), 6) AS quality,
round(least(1.0, CASE WHEN text = '' THEN 0 ELSE 0.5 + CASE WHEN w > 1000 THEN 0.2 WHEN w > 500 THEN 0.1 ELSE 0 END + CASE WHEN contains(text, chr(10) || chr(10)) OR contains(text, '. ') THEN 0.1 ELSE 0 END + CASE WHEN f > 5 THEN 0.2 WHEN f > 2 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(text, '\\b[0-9]+\\b') THEN 0.05 ELSE 0 END
+ CASE WHEN (CASE WHEN contains(lower(text), 'analysis') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'method') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'algorithm') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'model') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'data') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'study') THEN 1 ELSE 0 END) > 3 THEN 0.05 ELSE 0 END END), 6) AS transcript FROM d""")
def documentation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and quality of documentation, and of the same texts as transcripts."""
    d = table(spark, sf_dir, "documents").withColumn("flags", Q.indicators(F.col("text")))
    f = sum((F.col(f"flags.{n}").cast("int") for n in Q.INDICATORS), F.lit(0))
    kind = F.when(F.col("doc_id") % 3 == 0, "tutorial").when(F.col("doc_id") % 3 == 1, "reference")
    fields = {"n_words": F.size(T.words(F.col("text"))), "description": F.lit("d"), "n_headings": F.size(F.split("text", "\n", -1)) - 1, "relevant": F.col("text").contains("license"), "doc_type": kind}
    quality, transcript = Q.documentation_quality(fields, F.col("flags")), Q.transcript_quality(F.col("text"), f)
    return d.select("doc_id", f.alias("flags"), F.round(quality, 6).alias("quality"), F.round(transcript, 6).alias("transcript"))


@query("""WITH p AS (SELECT page_id, url, len(regexp_extract_all(html, '[^\\x20\\x09-\\x0D]+')) AS w, len(regexp_extract_all(html, '<h[1-6]')) AS h, contains(html, '<h1') AND contains(html, '<h2') AS b, len(regexp_extract_all(html, '<pre')) AS c, len(regexp_extract_all(html, '<a ')) AS l FROM pages),
s AS (SELECT page_id, CASE WHEN url <> '' THEN 0.2 ELSE 0 END + 0.1 + CASE WHEN w > 500 THEN 0.3 WHEN w > 200 THEN 0.15 ELSE 0 END + CASE WHEN l > 0 THEN 0.1 ELSE 0 END + CASE WHEN page_id % 2 = 0 THEN 0.2 ELSE 0 END AS k, CASE WHEN h > 5 THEN 0.3 WHEN h > 2 THEN 0.15 ELSE 0 END + CASE WHEN b THEN 0.2 ELSE 0 END AS t, CASE WHEN c > 3 THEN 0.3 WHEN c > 0 THEN 0.15 ELSE 0 END + CASE WHEN c > 0 AND page_id % 3 = 0 THEN 0.2 ELSE 0 END AS o FROM p)
SELECT page_id, round(k, 6) AS completeness, round(t, 6) AS structure, round(o, 6) AS code, round(k * 0.4 + t * 0.3 + o * 0.3, 6) AS overall FROM s""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, structure and code of documentation pages (M-17)."""
    p, html = table(spark, sf_dir, "pages"), F.col("html")
    code = F.regexp_count(html, F.lit("<pre"))
    fields = {"title": F.col("url"), "description": F.lit("d"), "n_words": F.size(T.words(html)), "n_links": F.regexp_count(html, F.lit("<a ")), "doc_type": F.when(F.col("page_id") % 2 == 0, "tutorial"), "n_headings": F.regexp_count(html, F.lit("<h[1-6]")), "has_h1": html.contains("<h1"), "has_h2": html.contains("<h2"), "n_code": code, "n_code_named": F.when(F.col("page_id") % 3 == 0, code).otherwise(0)}
    q = p.select("page_id", Q.page_quality(fields).alias("q"))
    return q.select("page_id", *(F.round(f"q.{x}", 6).alias(x) for x in ("completeness", "structure", "code", "overall")))
