"""Queries of clusters, citation statistics, set operations, query learning and model preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import graph as G
from granary.operators import learning as L
from granary.plans.registry import query, table

#: Suppliers of neighbouring numbers that share a nation are linked: chains, whose components SQL finds as islands.
_ISLANDS = "s AS (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0), i AS (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM s)"


@query(f"WITH {_ISLANDS} SELECT min(k) AS cluster, count(*) AS size, CASE WHEN count(*) > 2 THEN min(k) + 1 ELSE min(k) END AS central FROM i GROUP BY g HAVING count(*) >= 3")
def citation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of three nodes and more, each with its best linked node."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("src"))
    edges = s.join(s.select((F.col("src") - 1).alias("src"), F.col("src").alias("dst")), "src")
    return G.clusters(edges, 3)


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT dst AS node, CAST(year(o_orderdate) AS INT) AS year, count(*) AS citations FROM e JOIN orders ON o_orderkey = src GROUP BY ALL""")
def citations_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each node by the year of what cites it."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return G.cited_per_year(edges, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("year")))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, l_partkey % 10 AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> l_partkey % 10), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a FROM u WHERE a < 15)
SELECT (SELECT count(*) FROM n) AS nodes, count(*) // 2 AS edges, round(2.0 * (count(*) // 2) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 9) AS density, round(2.0 * (count(*) // 2) / (SELECT count(*) FROM n), 9) AS avg_degree FROM u WHERE a < 15 AND b < 15""")
def network_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, edges, density and mean degree of an induced network (G1)."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = li.select(F.col("s_nationkey").cast("long").alias("src"), (F.col("l_partkey") % 10).alias("dst")).distinct()
    nodes = G.undirected(edges).where("src < 15").select(F.col("src").alias("node")).distinct()
    d = G.density(edges, nodes)
    return d.select("nodes", "edges", F.round("density", 9).alias("density"), F.round("avg_degree", 9).alias("avg_degree"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS a FROM lineitem), p AS (SELECT x.a AS a, y.a AS b, count(*) AS w FROM e x JOIN e y ON x.g = y.g AND x.a < y.a GROUP BY ALL HAVING count(*) >= 2), u AS (SELECT a AS node, w FROM p UNION ALL SELECT b, w FROM p), d AS (SELECT node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM u GROUP BY 1)
SELECT node, degree, weight, CAST(row_number() OVER (ORDER BY degree DESC, weight DESC, node) AS INT) AS rank FROM d ORDER BY degree DESC, weight DESC, node LIMIT 10""")
def best_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members with most partners."""
    return G.centrality(G.together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 2), 10)


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def united_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ids of several results."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.where("doc_id % 2 = 0").unionByName(d.where("doc_id % 3 = 0")).distinct()


@query("SELECT count(*) AS positives, count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS found, round(count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) * 1.0 / count(*), 9) AS recall FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)")
def monitored_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many known positives a result holds."""
    p = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    en = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(1).alias("hit")).distinct()
    one = p.join(en, "doc_id", "left").agg(F.count(F.lit(1)).alias("positives"), F.count("hit").alias("found"))
    return one.select("positives", "found", F.round(F.col("found") / F.col("positives"), 9).alias("recall"))


@query("""WITH g AS (SELECT (length(text) % 20) AS b, quality AS y FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest(range(1, 20)) AS k), c AS (SELECT k, count(*) FILTER (b >= k AND y = 1) AS tp, count(*) FILTER (b >= k) AS p, count(*) FILTER (y = 1) AS good, count(*) AS n FROM g, t GROUP BY 1)
SELECT round(k / 20.0, 6) AS threshold, round(CASE WHEN p > 0 THEN tp / p END, 9) AS precision, round(tp / good, 9) AS recall, round(CASE WHEN n > p THEN (n - p - good + tp) / (n - p) END, 9) AS npv FROM c""")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and negative value on a grid of thresholds, in one pass."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(((F.length("text") % 20 + 0.5) / 20).alias("score"), F.col("quality").alias("y"))
    out = L.thresholds(d, "score", "y", 20)
    return out.select("threshold", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "npv")))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(trim(regexp_extract(text, '^([^.\\n]*)', 1))), '[\\p{L}\\p{N}_]+') AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM t)
SELECT gram, count(*) AS docs FROM g GROUP BY 1 HAVING count(*) >= 3""")
def title_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of one to three words and how many titles have them."""
    from granary.functions.text import title_of

    d = table(spark, sf_dir, "documents").select(F.explode(L.grams(title_of(F.col("text")), 3)).alias("gram"))
    return d.groupBy("gram").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 3")


@query("""WITH b AS (SELECT CAST(contains(lower(text), 'the ') AS INT) + 2 * CAST(contains(lower(text), 'licens') AS INT) + 4 * CAST(contains(lower(text), ' der ') AND contains(lower(text), 'ung') AS INT) AS b FROM documents), g AS (SELECT sum(b & 1) AS g0, sum((b & 2) // 2) AS g1, sum((b & 4) // 4) AS g2, count(*) FILTER (b > 0) AS n FROM b)
SELECT CASE WHEN g0 >= g1 AND g0 >= g2 THEN 0 WHEN g1 >= g2 THEN 1 ELSE 2 END AS query, CAST(greatest(g0, g1, g2) AS BIGINT) AS gain FROM g""")
def first_learned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that covers most, the first step of a greedy cover."""
    d = table(spark, sf_dir, "documents")
    found = L.greedy_cover(d, "text", [[["the "]], [["licens"]], [[" der "], ["ung"]]], 0.99, 1)
    return spark.range(1).select(F.lit(found[0][0]).alias("query"), F.lit(found[0][1]).cast("long").alias("gain"))


@query("""WITH c AS (SELECT lower(text) AS t, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT count(*) FILTER (contains(t, 'the ') AND contains(t, 'and ')) AS together, count(*) FILTER (contains(t, 'the ')) AS base, round(count(*) FILTER (contains(t, 'the ') AND contains(t, 'and ')) * 1.0 / count(*) FILTER (contains(t, 'the ')), 9) AS share FROM c WHERE y = 1""")
def context_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a context term stands beside a phrase."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1")
    both = L.matches_query(F.col("text"), [["the "], ["and "]])
    one = d.agg(F.count_if(both).alias("together"), F.count_if(L.matches_query(F.col("text"), [["the "]])).alias("base"))
    return one.select("together", "base", F.round(F.col("together") / F.col("base"), 9).alias("share"))


@query("""SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(len(w) AS DOUBLE) AS n_tokens, CAST(len(list_distinct(w)) AS DOUBLE) AS n_distinct, CASE WHEN regexp_matches(text, '[0-9]') THEN 1.0 ELSE 0.0 END AS has_number, CASE WHEN regexp_matches(text, '(?i)\\bmethods?\\b') THEN 1.0 ELSE 0.0 END AS has_method FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)""")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features of texts (L2-L4)."""
    d = table(spark, sf_dir, "documents").select("doc_id", *L.features(F.col("text")))
    return d.select("doc_id", "n_chars", "n_tokens", "n_distinct", "has_number", "has_method")


@query()
def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest probabilities of rows that the model didn't see, calibrated on such."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), *L.features(F.col("text")))
    scored = L.out_of_fold(d, "doc_id", ["n_chars", "n_tokens", "n_distinct", "has_number"], "y", folds=2, trees=5, depth=4)
    return L.calibrator(scored, "y").transform(scored).select("doc_id", "y", "probability", "calibrated")


@query("SELECT least(g, 4) AS fold_group, count(*) AS n FROM (SELECT doc_id % 5 AS g FROM documents) GROUP BY 1")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each group of a split."""
    return table(spark, sf_dir, "documents").groupBy(F.least(F.col("doc_id") % 5, F.lit(4)).alias("fold_group")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT doc_id, lang, source, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM (SELECT * FROM a WHERE lang = 'en' UNION ALL SELECT * FROM a WHERE n_chars > 3000 UNION ALL SELECT * FROM a WHERE lang = 'de')) SELECT source, doc_id FROM r WHERE i = 1""")
def forum_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several result lists in one, each key once, the best first (SC18, Z21)."""
    from granary.operators import linking as K

    a = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    every = K.union_sources([a.where("lang = 'en'"), a.where("n_chars > 3000"), a.where("lang = 'de'")])
    return K.first_seen(every, ["source"], [-F.col("n_chars"), "doc_id"]).select("source", "doc_id")


@query("""WITH p AS (SELECT o_orderkey AS node, year(o_orderdate) AS year, [o_custkey % 9, o_custkey % 11 + 100] AS authors FROM orders), e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey <> l_partkey), t AS (SELECT CAST(1998 AS BIGINT) AS now),
m AS (SELECT e.dst, count(*) AS c, count(*) FILTER (a.year IN (now - 1, now)) AS r, count(*) FILTER (list_has_any(a.authors, b.authors)) AS o FROM e JOIN p b ON b.node = e.dst LEFT JOIN p a ON a.node = e.src, t GROUP BY 1), x AS (SELECT src, count(*) AS n FROM e GROUP BY 1)
SELECT node, CAST(now - year AS INT) AS years, coalesce(c, 0) AS citations, coalesce(n, 0) AS "references", round(coalesce(c, 0) / greatest(now - year, 1), 6) AS velocity, coalesce(r, 0) AS recent, coalesce(o, 0) AS own FROM p LEFT JOIN m ON m.dst = node LEFT JOIN x ON x.src = node, t""")
def citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, their speed, recent ones and those by one's own."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("year"), F.array(F.col("o_custkey") % 9, F.col("o_custkey") % 11 + 100).alias("authors"))
    return G.citation_stats(edges, papers, 1998).withColumn("velocity", F.round("velocity", 6))
