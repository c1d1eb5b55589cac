"""Queries of the multi-step analyses, over orders by nation and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import analytics as A
from granary.operators import graph as G
from granary.operators import learning as L
from granary.plans.registry import query, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with year and nation, the entity of the analyses."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "orders").join(c, "o_custkey").join(n, "n_nationkey").withColumn("year", F.year("o_orderdate").cast("long"))


_BASE = "o AS (SELECT orders.*, n_name, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT year, n_name AS entity, count(*) AS n FROM o GROUP BY ALL)"
_SHARES = f"{_BASE}, t AS (SELECT year, count(*) AS total FROM o GROUP BY 1), b AS (SELECT entity FROM c GROUP BY 1 ORDER BY sum(n) DESC, entity LIMIT 5), s AS (SELECT year, entity, n, total, round(n * 100.0 / total, 1) AS share FROM c JOIN b USING (entity) JOIN t USING (year))"


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return A.shares(A.yearly_counts(o, F.col("year"), F.col("n_name")), o.groupBy("year").agg(F.count(F.lit(1)).alias("total")))


@query(f"WITH {_SHARES} SELECT year, entity, n, total, share FROM s")
def share_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the five largest entities by year."""
    return _shares(spark, sf_dir)


@query(f"""WITH {_SHARES}, e AS (SELECT entity, arg_min(share, year) AS first_share, arg_max(share, year) AS last_share FROM s GROUP BY 1)
SELECT entity, first_share, last_share, round(last_share - first_share, 1) AS change, round(CASE WHEN first_share > 0 THEN (last_share - first_share) / first_share * 100 ELSE 0 END, 1) AS relative_change FROM e""")
def share_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the shares changed from the first to the last year."""
    return A.share_changes(_shares(spark, sf_dir))


@query(f"""WITH {_SHARES}, e AS (SELECT entity, arg_min(share, year) AS f, arg_max(share, year) AS l FROM s GROUP BY 1)
SELECT entity, printf('%s %s from %.1f%% to %.1f%%', entity, CASE WHEN round(l - f, 1) > 0 THEN 'rose' WHEN round(l - f, 1) < 0 THEN 'fell' ELSE 'held' END, f, l) AS text FROM e""")
def share_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each entity."""
    return A.narrative(A.share_changes(_shares(spark, sf_dir)))


_MONTHS = "m AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1), g AS (SELECT *, lag(n) OVER (ORDER BY year) AS previous FROM m)"


@query(f"WITH {_MONTHS} SELECT CAST(year AS BIGINT) AS year, n, previous, round((n - previous) * 100.0 / previous, 1) AS growth, CASE WHEN year = 199505 THEN 'spring release' ELSE 'No known event' END AS event FROM g WHERE previous > 0 AND (n - previous) * 100.0 / previous > 30")
def surges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that grew by more than 30 percent, with known events."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    per = o.groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return A.with_events(A.surges(per), spark.createDataFrame([(199505, "spring release")], "year long, event string"))


@query(f"""WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n, entity) AS i, row_number() OVER (PARTITION BY year ORDER BY n DESC, entity) AS d FROM c),
g AS (SELECT year, count(*) AS k, sum(n) AS s, sum(i * n) AS w, sum(CASE WHEN d <= 5 THEN n ELSE 0 END) AS t FROM r GROUP BY 1)
SELECT year, k AS entities, round(2.0 * w / (k * s) - (k + 1.0) / k, 3) AS gini, round(t * 100.0 / s, 1) AS top_share, round(100 - t * 100.0 / s, 1) AS rest_share FROM g WHERE k > 1""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gini coefficient and the share of the five largest, by year."""
    return A.concentration(A.yearly_counts(_orders(spark, sf_dir), F.col("year"), F.col("n_name")))


@query(f"""WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n, entity) AS i FROM c), g AS (SELECT year, round(2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 3) AS gini FROM r GROUP BY 1 HAVING count(*) > 1),
z AS (SELECT *, row_number() OVER (ORDER BY year) AS a, row_number() OVER (ORDER BY year DESC) AS z FROM g), m AS (SELECT count(*) AS years, avg(CASE WHEN a <= 3 THEN gini END) AS early, avg(CASE WHEN z <= 3 THEN gini END) AS late FROM z)
SELECT years, round(early, 4) AS early, round(late, 4) AS late, CASE WHEN years < 3 THEN 'insufficient_data' WHEN late - early > 0.05 THEN 'increasing' WHEN late - early < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend FROM m""")
def concentration_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early against late years."""
    return A.trend(concentration(spark, sf_dir))


@query(f"WITH {_BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, entity) AS rank FROM c WHERE year >= 2000) SELECT year, entity, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest entities of chosen years."""
    counts = A.yearly_counts(_orders(spark, sf_dir), F.col("year"), F.col("n_name"))
    return A.contributors(counts, counts.where("year >= 2000").select("year").distinct())


@query("""SELECT lang AS key, count(*) AS doc_count FROM documents WHERE source = 'src7' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next dimension within what was clicked."""
    return A.drill_down(table(spark, sf_dir, "documents"), {"source": "src7"}, "lang")


@query("""WITH t AS (SELECT source AS key FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3) SELECT lang, count(*) AS n FROM documents WHERE source IN (SELECT key FROM t) GROUP BY 1""")
def chained_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of one result filter the next."""
    d = table(spark, sf_dir, "documents")
    first = d.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(3)
    return A.within_result(d, "source", first).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_CONF = "q AS (SELECT doc_id, CASE WHEN contains(text, '|') THEN 0 ELSE 1 END AS p, quality AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn FROM q)"


@query(f"WITH {_CONF} SELECT tp, fp, tn, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr FROM c")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and their ratios for a simple rule."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return L.confusion(d, F.col("quality"), ~F.col("text").contains("|"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) AS least, max(CASE WHEN i = n // 2 THEN value END) AS median, max(value) AS most FROM r GROUP BY 1""")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper median and most of each class."""
    return L.score_spread(table(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH w AS (SELECT DISTINCT doc_id, quality AS y, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents JOIN labels USING (doc_id)), p AS (SELECT sum(quality) AS a FROM documents JOIN labels USING (doc_id)),
s AS (SELECT term, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 20) SELECT term, pos, n - pos AS neg, round(pos / a, 6) AS coverage, round(pos / n, 6) AS specificity FROM s, p""")
def term_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and specificity of words for labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    s = L.term_statistics(d, "text", "quality", most=1, least_docs=20)
    return s.select("term", "pos", "neg", F.round("coverage", 6).alias("coverage"), F.round("specificity", 6).alias("specificity"))


@query("""WITH m AS (SELECT count(*) FILTER (contains(lower(text), 'the ')) AS a, count(*) FILTER (contains(lower(text), 'licens')) AS b, count(*) AS n FROM documents) SELECT 'article' AS name, a / n AS share FROM m UNION ALL SELECT 'license', b / n FROM m""")
def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of documents that a boolean query finds."""
    d = table(spark, sf_dir, "documents")
    one = d.agg(*((F.count_if(L.matches_query(F.col("text"), q)) / F.count(F.lit(1))).alias(n) for n, q in (("article", [["the "]]), ("license", [["licens"]]))))
    return one.unpivot([], ["article", "license"], "name", "share")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS a FROM lineitem), p AS (SELECT x.a AS a, y.a AS b, count(*) AS weight FROM o x JOIN o y ON x.g = y.g AND x.a < y.a GROUP BY ALL) SELECT a, b, weight FROM p WHERE weight >= 2""")
def supplied_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of members that share groups."""
    return G.together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 2)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from orders' first parts to their other parts, as a citation graph."""
    li = table(spark, sf_dir, "lineitem")
    first = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("src"))
    rest = li.where("l_linenumber > 1").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return first.join(rest, "l_orderkey").where("src <> dst").select("src", "dst").distinct()


_EDGES = "e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber > 1 AND a.l_partkey <> b.l_partkey), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(f"WITH {_EDGES}, h1 AS (SELECT DISTINCT dst AS node FROM u WHERE src = 1), h2 AS (SELECT DISTINCT dst AS node FROM u JOIN h1 ON src = node WHERE dst <> 1 AND dst NOT IN (SELECT node FROM h1)) SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops (G1)."""
    return G.ego(_citations(spark, sf_dir), 1, 2)


@query(f"WITH {_EDGES} SELECT node, count(*) AS triangles FROM (SELECT unnest([x.src, x.dst, y.dst]) AS node FROM u x JOIN u y ON x.dst = y.src JOIN u z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND x.dst < y.dst) GROUP BY 1")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of each node (G1)."""
    return G.triangles(_citations(spark, sf_dir))


@query(f"""WITH {_EDGES} SELECT 1 AS hops, [e.src, e.dst] AS path FROM e WHERE src = 1 AND dst = 2 UNION ALL SELECT 2, [a.src, a.dst, b.dst] FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 1 AND b.dst = 2 AND a.dst <> 2
UNION ALL SELECT 3, [a.src, a.dst, b.dst, c.dst] FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 1 AND c.dst = 2 AND a.dst NOT IN (2) AND b.dst NOT IN (1, 2, a.dst)""")
def citation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths of at most three hops."""
    return G.paths(_citations(spark, sf_dir), 1, 2, 3)


@query(f"WITH {_EDGES}, c AS (SELECT dst AS node, count(*) AS citations FROM e GROUP BY 1), b AS (SELECT quantile_cont(citations, 0.99) AS b FROM c) SELECT node, citations FROM c, b WHERE citations >= b")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cited hundredth."""
    return G.milestones(_citations(spark, sf_dir))


@query("""WITH t AS (SELECT max(ts) AS t FROM events), c AS (SELECT user_id, count(*) FILTER (ts > t - INTERVAL 10 DAYS) AS n, count(*) FILTER (ts <= t - INTERVAL 10 DAYS) AS before FROM events, t WHERE ts > t - INTERVAL 20 DAYS AND user_id IS NOT NULL GROUP BY 1)
SELECT user_id, n, before, CASE WHEN n > before * CAST(1.1 AS DOUBLE) THEN 'up' WHEN n < before * CAST(0.9 AS DOUBLE) THEN 'down' ELSE 'stable' END AS trend FROM c""")
def user_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two periods and where they go."""
    e = table(spark, sf_dir, "events")
    newest = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return A.trends(e, "user_id", "ts", newest, 10)


@query("""WITH r AS (SELECT unnest(['0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1']) AS range, unnest([0, 20, 40, 60, 80]) AS a, unnest([20, 40, 60, 80, 101]) AS b), d AS (SELECT n_chars % 103 AS s FROM documents), c AS (SELECT range, count(s) AS n FROM r LEFT JOIN d ON s >= a AND s < b GROUP BY 1)
SELECT range, n, round(100.0 * n / (SELECT sum(n) FROM c), 6) AS percentage FROM c""")
def quality_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How scores are spread over ranges, those out of range left out."""
    scored = table(spark, sf_dir, "documents").select(((F.col("n_chars") % 103).cast("double") / 100).alias("score"))
    return A.range_shares(scored, "score", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).withColumn("percentage", F.round("percentage", 6))
