"""Queries of the structure of texts: outlines, sections, summaries, trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as E
from granary.functions import outline as O
from granary.functions import quality
from granary.plans.registry import query, table

#: What the queries over the test tables look for.
TERMS = ("reporting", "the ", "der ", "que ")


@query("""WITH s AS (SELECT doc_id, text, unnest(string_split_regex(text, '[.!?]+')) AS s, generate_subscripts(string_split_regex(text, '[.!?]+'), 1) AS i FROM documents),
r AS (SELECT doc_id, s, i, (SELECT sum(CASE WHEN contains(lower(s), w) THEN p ELSE 0 END) FROM (VALUES ('reporting', 2), ('the ', 2), ('der ', 2), ('que ', 2), ('important', 1), ('key', 1), ('main', 1), ('critical', 1), ('essential', 1)) v(w, p)) AS score FROM s WHERE length(s) >= 20),
c AS (SELECT doc_id, s, row_number() OVER w AS k, sum(length(s)) OVER w AS size FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, i)),
f AS (SELECT doc_id, min(k) FILTER (size > 500) AS stop FROM c GROUP BY 1),
j AS (SELECT c.doc_id, string_agg(trim(s, ' '), '. ' ORDER BY k) || '.' AS summary FROM c JOIN f USING (doc_id) WHERE stop IS NULL OR k < stop GROUP BY 1)
SELECT doc_id, coalesce(summary, left(text, 500), '') AS summary FROM documents LEFT JOIN j USING (doc_id)""")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive summaries of all texts."""
    return table(spark, sf_dir, "documents").select("doc_id", O.summary(F.col("text"), TERMS).alias("summary"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents; one of at most 60 characters is a heading: level 1 first, 2 up to three words, else 3."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    head = F.length("line").between(1, 60)
    level = F.when(F.col("pos") == 0, 1).when(F.size(F.split("line", " ", -1)) <= 3, 2).otherwise(3)
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", head.alias("heading"), level.alias("level"))


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, line, length(line) BETWEEN 1 AND 60 AS heading, CASE WHEN pos = 0 THEN 1 WHEN len(string_split(line, ' ')) <= 3 THEN 2 ELSE 3 END AS level FROM l)"""


@query(f"""WITH {_LINES}, o AS (SELECT * FROM h WHERE heading)
SELECT doc_id, pos, level, line, (SELECT arg_max(p.line, p.pos) FROM o p WHERE p.doc_id = o.doc_id AND p.pos < o.pos AND p.level < o.level) AS parent,
       (SELECT min(n.pos) FROM o n WHERE n.doc_id = o.doc_id AND n.pos > o.pos AND n.level <= o.level) AS until FROM o""")
def heading_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the one they belong to and where their section ends."""
    out = O.outline(_lines(spark, sf_dir).where("heading").drop("heading"), "doc_id", "pos", "level", "line", 3)
    return out.select("doc_id", "pos", "level", "line", "parent", "until")


@query(f"""WITH {_LINES}, n AS (SELECT *, (SELECT max(p.pos) FROM h p WHERE p.doc_id = h.doc_id AND p.pos <= h.pos AND p.heading) AS start FROM h)
SELECT doc_id, start, max(line) FILTER (heading) AS title, count(*) FILTER (NOT heading) AS n_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT heading), '')) AS body FROM n GROUP BY 1, 2""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands under each heading."""
    out = O.sections(_lines(spark, sf_dir), "doc_id", "pos", "line", F.col("heading"))
    return out.withColumn("body", F.sha2("body", 256))


@query("""WITH p AS (SELECT page_id, list_filter(string_split(url, '/')[4:], lambda x: x <> '' AND NOT starts_with(x, '?')) AS parts, regexp_extract_all(html, 'href="(http[^"]*)"', 1) AS links FROM pages)
SELECT page_id, array_to_string(list_transform(parts, lambda x: array_to_string(list_transform(regexp_extract_all(replace(replace(x, '-', ' '), '_', ' '), '\\p{L}+|[^\\p{L}]+'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')), ' > ') AS trail,
       len(list_filter(links, lambda u: contains(lower(u), 'example'))) AS internal, len(list_filter(links, lambda u: NOT contains(lower(u), 'example'))) AS external FROM p""")
def page_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails from addresses, and links by side."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="(http[^"]*)"'), F.lit(1))
    d = table(spark, sf_dir, "pages").select("page_id", F.array_join(O.breadcrumbs(F.col("url")), " > ").alias("trail"), O.links_by_side(links, "example").alias("l"))
    return d.select("page_id", "trail", F.size("l.internal").cast("long").alias("internal"), F.size("l.external").cast("long").alias("external"))


@query("""WITH t AS (SELECT page_id, coalesce(url, '') AS url, lower(coalesce(url, '') || ' ' || substr(coalesce(html, ''), 1, 1000)) AS t FROM pages),
d AS (SELECT *, CASE WHEN regexp_matches(t, 'tutorial|guide|how[-\\s]?to|getting[-\\s]?started|quickstart') THEN 'tutorial' WHEN regexp_matches(t, 'api|reference|specification|interface') THEN 'api' WHEN regexp_matches(t, 'install|setup|configuration|deploy') THEN 'installation'
  WHEN regexp_matches(t, 'concept|overview|introduction|about') THEN 'concept' WHEN regexp_matches(t, 'faq|frequently[-\\s]?asked|questions') THEN 'faq' WHEN regexp_matches(t, 'troubleshoot|debug|error|issue|problem') THEN 'troubleshooting'
  WHEN regexp_matches(t, 'example|sample|demo|use[-\\s]?case') THEN 'example' WHEN regexp_matches(t, 'best[-\\s]?practice|recommendation|guideline') THEN 'best_practice' ELSE 'reference' END AS doc_type FROM t)
SELECT page_id, doc_type, round(CASE WHEN url <> '' THEN 0.2 ELSE 0 END + CASE WHEN doc_type IN ('tutorial', 'example', 'installation') THEN 0.2 ELSE 0 END, 6) AS completeness FROM d""")
def typed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of a page, and its completeness, to which the type adds (M-17, X50)."""
    d = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("title"), E.doc_type(F.lit(None).cast("string"), F.col("url"), F.col("html")).alias("doc_type"))
    q = quality.page_quality({"title": F.col("title"), "doc_type": F.col("doc_type")})
    return d.select("page_id", "doc_type", F.round(q["completeness"], 6).alias("completeness"))
