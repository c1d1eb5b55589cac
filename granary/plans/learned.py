"""Queries of title ratios, explained predictions and learned search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import title_of
from granary.operators import explain, titles
from granary.operators import learning as L
from granary.operators import query_learning as Q
from granary.plans.registry import query, table
from granary.session import durable


#: Labels are broadcast up to so many, and then no text is sent; of more, documents and labels are dealt by id.
BROADCAST_LABELS = 2_000_000


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, one row an id, in lower case."""
    rows = table(spark, sf_dir, "labels")
    labels = rows.groupBy("doc_id").agg(F.max("quality").alias("y"))
    labels = F.broadcast(labels) if rows.count() <= BROADCAST_LABELS else labels
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select("doc_id", F.lower("text").alias("text"), "source", F.col("y").cast("int").alias("y"))


@query()
def near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents whose title is nearly that of a labelled one, by the sequence ratio."""
    d = table(spark, sf_dir, "documents").select("doc_id", title_of(F.col("text")).alias("title"))
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return titles.near_titles(d.join(known, "doc_id", "left_anti"), d.join(known, "doc_id", "left_semi"), "doc_id", "title")


@query()
def explained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest probabilities of all documents and the features that moved each most."""
    d = table(spark, sf_dir, "documents").select("doc_id", *L.features(F.col("text")))
    names = [c for c in d.columns if c != "doc_id"]
    fit = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    model = L.forest(fit, names, "y", trees=20, depth=6).stages[-1]
    rows = d.select("doc_id", F.array(*names).alias("x"))
    out = explain.contributions(rows, "doc_id", "x", names, explain.node_table(model, spark))
    return out.select("doc_id", "probability", "base", "total", F.to_json("factors").alias("factors"))


#: Common words of the labelled texts: how many are looked at, and the queries made of them.
WORDS = 80
_STATS = """d AS (SELECT doc_id, lower(text) AS t, y FROM documents JOIN (SELECT doc_id, max(quality) AS y FROM labels GROUP BY 1) USING (doc_id)), p AS (SELECT * FROM d WHERE y = 1),
s AS (SELECT term, sum(y) / (SELECT count(*) FROM p) AS coverage, sum(y) / count(*) AS specificity FROM (SELECT DISTINCT doc_id, y, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS term FROM d) GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT *, row_number() OVER (ORDER BY round(coverage * specificity, 12) DESC, term) - 1 AS n FROM s WHERE length(term) > 4 QUALIFY n < 80)"""


def _terms(labelled: DataFrame) -> list[Q.Term]:
    return Q.top_terms(L.term_statistics(labelled, "text", "y").where(F.length("term") > 4), WORDS)


@query(f"""WITH {_STATS}, f AS (SELECT doc_id, term, n, coverage * specificity AS weight FROM p, t WHERE contains(p.t, term)),
c AS (SELECT term, count(*) AS n_a FROM f GROUP BY 1 HAVING count(*) >= 3),
j AS (SELECT a.term AS a, b.term AS b, b.n, count(*) AS joint, any_value(b.weight) AS weight FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.term <> b.term GROUP BY ALL)
SELECT a AS term, array_to_string(list_reduce(list(b ORDER BY -round(joint / n_a * weight, 12), n), lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda k: contains(k, x[1]) OR contains(x[1], k))) = 0 THEN list_concat(acc, x) ELSE acc END, CAST([] AS VARCHAR[])), ',') AS contexts
FROM (SELECT a, [b] AS b, joint, n_a, weight, n FROM j JOIN c ON c.term = a WHERE joint >= 0.3 * n_a - 1e-9 AND length(b) > 2 AND NOT contains(a, b) AND NOT contains(b, a)) GROUP BY 1""")
def phrase_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each term the terms that stand beside it most, none inside another."""
    d = _labelled(spark, sf_dir)
    terms = _terms(d)
    found = Q.occurrences(d.where("y = 1"), "doc_id", F.col("text"), [t.term for t in terms])
    return Q.context_terms(found, terms).select("term", F.array_join("contexts", ",").alias("contexts"))


@query(f"""WITH RECURSIVE {_STATS}, m AS MATERIALIZED (SELECT doc_id, n FROM p, t WHERE contains(p.t, term)),
sets AS MATERIALIZED (SELECT list(n) AS qs, count(*) OVER () AS dummy FROM m GROUP BY doc_id),
go AS (SELECT 0::BIGINT AS rank, CAST([] AS BIGINT[]) AS chosen
  UNION ALL SELECT rank + 1, list_append(chosen, (SELECT q FROM (SELECT unnest(qs) AS q FROM sets WHERE NOT list_has_any(qs, chosen)) GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) FROM go
  WHERE rank < 15 AND (SELECT count(*) FROM sets WHERE list_has_any(qs, chosen)) < 0.999 * (SELECT count(*) FROM p) AND (SELECT count(*) FROM sets WHERE NOT list_has_any(qs, chosen)) > 0),
r AS (SELECT rank, chosen, chosen[-1] AS q, (SELECT count(*) FROM sets WHERE list_has_any(qs, chosen)) AS covered FROM go WHERE rank > 0)
SELECT rank, term AS query, (SELECT count(*) FROM m WHERE m.n = q) AS total_matches, covered - coalesce(lag(covered) OVER (ORDER BY rank), 0) AS new_matches, covered, round(covered / (SELECT count(*) FROM p), 9) AS recall FROM r JOIN t ON t.n = q""")
def cover_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of a greedy cover by 80 queries of one word."""
    d = _labelled(spark, sf_dir)
    queries = [Q.Candidate(t.term, "word", ((t.term,),)) for t in _terms(d)]
    rounds = Q.cover(Q.matches(d.where("y = 1"), "doc_id", "text", queries), target=0.999)
    return Q.report(d, rounds, queries).select("rank", F.col("name").alias("query"), "total_matches", "new_matches", "covered", "recall")


@query()
def learned_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries learned from the labelled documents: terms, candidates of all strategies, cover, rounds."""
    d = durable(_labelled(spark, sf_dir).drop("source"))  # read by each of the steps
    words = durable(L.term_statistics(d, "text", "y"))
    brand = Q.top_terms(words.where(F.length("term") > 4), 200, 0.1, 0.8)[:5]
    best = {t.term: t for t in Q.best_terms(d, "text", "y", words, 100, shortest=5)}
    scored = spark.createDataFrame([(t.term, t.coverage * t.specificity) for t in best.values()], "term string, score double")
    kept = {r["term"] for r in Q.without_subsumed(scored.withColumn("score", F.round("score", 12))).collect()}
    queries = Q.candidates(d.where("y = 1"), d.where("y = 0"), "doc_id", "text", brand, [t for name, t in best.items() if name in kept], shortest=5)
    return Q.report(d, Q.cover(Q.matches(d.where("y = 1"), "doc_id", "text", queries)), queries)


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(trim(regexp_extract(text, '^([^.\\n]*)', 1))), '[\\p{L}\\p{N}_]+') AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM t),
s AS (SELECT term, count(*) AS score FROM g GROUP BY 1 HAVING count(*) >= 3)
SELECT term, score FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE contains(b.term, a.term) AND b.term <> a.term AND (b.score > a.score OR b.score = a.score AND b.term < a.term))""")
def kept_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of titles that no better phrase contains."""
    d = table(spark, sf_dir, "documents").select(F.explode(L.grams(title_of(F.col("text")), 3)).alias("term"))
    return Q.without_subsumed(d.groupBy("term").agg(F.count(F.lit(1)).alias("score")).where("score >= 3"))


@query("""WITH p AS (SELECT doc_id, source, lower(text) AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), o AS (SELECT source FROM p GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10),
h AS (SELECT contains(t, 'the ') OR contains(t, 'que ') AS hit, source IN (FROM o) AS known FROM p)
SELECT count(*) AS total, count(*) FILTER (hit) AS by_queries, count(*) FILTER (NOT hit AND known) AS by_people, round(count(*) FILTER (hit OR known) / count(*), 9) AS recall FROM h""")
def watched_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of two queries, and with the sources of ten documents and more watched besides."""
    d = _labelled(spark, sf_dir).where("y = 1")
    queries = [Q.Candidate(w, "word", ((w,),)) for w in ("the ", "que ")]
    out = Q.watched(Q.matches(d, "doc_id", "text", queries), [0, 1], d, "doc_id", "source")
    return out.withColumn("recall", F.round("recall", 9))
