"""The ingestion pipeline in one plan: type, duplicates, validation, quality, final score, route, and what became of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import quality as Q
from granary.functions import scores as S
from granary.functions import text as T
from granary.operators import linking as K
from granary.plans.registry import query, table

_KINDS = ("article", "video", "repository", "discussion", "documentation")

_RUN = """d AS (SELECT doc_id AS id, text, n_chars, md5(text) AS h, trim(regexp_extract(text, '^([^.\\n]*)', 1)) AS title, list_extract(['article', 'video', 'repository', 'discussion', 'documentation'], CAST(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 5 + 1 AS INT)) AS kind FROM documents),
old AS (SELECT * FROM d WHERE id IN (SELECT doc_id FROM labels)), byh AS (SELECT h, min(id) AS i FROM old GROUP BY 1), byt AS (SELECT title, min(id) AS j FROM old GROUP BY 1),
c AS (SELECT d.*, coalesce(i, j) AS duplicate_of FROM d LEFT JOIN byh USING (h) LEFT JOIN byt USING (title) WHERE id NOT IN (SELECT doc_id FROM labels)),
s AS (SELECT *, CAST(length(text) % 100 AS DOUBLE) / 100 AS combined, CAST(0.5 + CASE kind WHEN 'article' THEN CASE WHEN length(text) > 500 THEN 0.1 ELSE 0 END WHEN 'video' THEN CASE WHEN text <> '' THEN 0.2 ELSE 0 END WHEN 'repository' THEN CASE WHEN length(text) > 1000 THEN 0.15 ELSE 0 END WHEN 'documentation' THEN CASE WHEN length(text) > 2000 THEN 0.1 ELSE 0 END ELSE 0 END AS DOUBLE) AS q,
CAST(CASE kind WHEN 'article' THEN 0.3 WHEN 'video' THEN 0.4 WHEN 'repository' THEN 0.35 WHEN 'discussion' THEN 0.25 ELSE 0.5 END AS DOUBLE) AS w FROM c),
f AS (SELECT *, round(combined * (1 - w) + q * w, 9) AS final FROM s), t AS (SELECT *, CASE WHEN final >= 0.7 THEN 'approved' WHEN final >= 0.5 THEN 'review_high' WHEN final >= 0.3 THEN 'review_low' ELSE 'rejected' END AS tier FROM f),
o AS (SELECT id, kind, duplicate_of, final AS final_score, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN n_chars < 50 THEN 'invalid' ELSE tier END AS outcome, CAST(least(10, CASE tier WHEN 'review_high' THEN 7 WHEN 'review_low' THEN 3 ELSE 5 END + least(3, floor(final * 3))) AS INT) AS priority FROM t)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents as what comes in, labelled ones as what is there; each step adds columns, and two joins find duplicates."""
    number = F.expr("coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0)") % 5
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars", F.md5("text").alias("h"), T.title_of(F.col("text")).alias("title"), F.element_at(F.array(*map(F.lit, _KINDS)), number + 1).alias("kind"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    rows = K.duplicate_cascade(d.join(known, "id", "left_anti"), d.join(known, "id", "left_semi"), [["h"], ["title"]])
    quality = Q.classifier_quality(F.col("kind"), {"abstract": F.col("text"), "content": F.col("text"), "transcript": F.col("text")}, "none")
    final = F.round(S.final_score((F.length("text") % 100).cast("double") / 100, quality, F.col("kind")), 9)
    rows = rows.withColumn("final_score", final).withColumn("tier", S.route(F.col("final_score")))
    outcome = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("n_chars") < 50, "invalid").otherwise(F.col("tier"))
    level = F.when(F.col("tier") == "review_high", "high").when(F.col("tier") == "review_low", "low").otherwise("medium")
    return rows.select("id", "kind", "duplicate_of", "final_score", outcome.alias("outcome"), S.priority(level, F.col("final_score")).cast("int").alias("priority"))


@query(f"WITH {_RUN} SELECT * FROM o")
def ingested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each new row (CT1, CT2, Z23, Z26, Z28-Z31)."""
    return _outcomes(spark, sf_dir)


@query(f"WITH {_RUN} SELECT kind, outcome, count(*) AS n, round(avg(final_score), 9) AS mean_score FROM o GROUP BY ALL")
def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's counters by type and outcome, and the running means of scores."""
    return _outcomes(spark, sf_dir).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final_score"), 9).alias("mean_score"))


@query(f"WITH {_RUN}, m AS (SELECT duplicate_of AS id, count(*) AS more FROM o WHERE outcome = 'duplicate' GROUP BY 1) SELECT old.id, coalesce(more, 0) AS citation_count FROM old LEFT JOIN m USING (id)")
def patched_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates patch the counts of the rows that are there (ST5, SK4, Z22, Z23)."""
    from granary.operators import review as V

    d, known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    there = d.join(known, "id", "left_semi").withColumn("citation_count", F.lit(0).cast("long"))
    changes = _outcomes(spark, sf_dir).where("outcome = 'duplicate'").groupBy(F.col("duplicate_of").alias("id")).agg(F.count(F.lit(1)).alias("citation_count"))
    return V.patch(there, changes, ["citation_count"])
