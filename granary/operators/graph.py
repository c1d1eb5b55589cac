"""Graph queries over edge tables (G1-G7, L24, W7): ego networks, paths, statistics, clusters, co-occurrence.

Contract-defined: the reference gives the result types, the algorithms are ours. A hop is a join; frontiers are
de-duplicated before each hop, and loops cut their lineage with checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.buckets import value_at
from granary.session import durable


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def ego(edges: DataFrame, centre: object, depth: int = 2, most: int | None = None) -> DataFrame:
    """node, hops: the nodes within `depth` hops, nearest first, at most `most` (G1)."""
    links = durable(edges.select("src", "dst").where("src <> dst"))
    seen = links.sparkSession.range(1).select(F.lit(centre).cast("long").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        ends = frontier.select("node")
        near = _from(links, "src", "dst", ends).unionByName(_from(links, "dst", "src", ends)).distinct()
        frontier = durable(near.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    out = seen.orderBy("hops", "node")
    return out.limit(most) if most else out


#: Frontiers of up to so many nodes are broadcast, so that the edges stay where they are.
FRONTIER_ROWS = 500_000


def _from(links: DataFrame, near: str, far: str, nodes: DataFrame) -> DataFrame:
    """node: the far ends of the links whose near end is one of the nodes."""
    some = nodes.select(F.col("node").alias(near))
    small = some.limit(FRONTIER_ROWS + 1).count() <= FRONTIER_ROWS
    return links.join(F.broadcast(some) if small else some, near, "left_semi").select(F.col(far).alias("node"))


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges, density, avg_degree of the induced undirected graph (G1); nodes: node."""
    inside = undirected(edges).join(nodes.select(F.col("node").alias("src")), "src").join(nodes.select(F.col("node").alias("dst")), "dst")
    m = inside.agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    both = n.join(m)  # one row each
    return both.select("nodes", "edges", F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"), F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")).otherwise(0.0).alias("avg_degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles: each triangle is found once, from its node of the least degree (G1)."""
    links = undirected(edges)
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    a = links.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    up = a.where("d < e or (d = e and src < dst)").select("src", "dst")
    pairs = up.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(up.select(F.col("src").alias("x"), F.col("dst").alias("z")), "x").where("y < z")
    closed = pairs.join(links.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def paths(edges: DataFrame, start: object, end: object, longest: int = 4) -> DataFrame:
    """hops, path: the simple directed paths of at most `longest` hops."""
    links = durable(edges.select("src", "dst").distinct())
    open_ = links.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    out = None
    for hop in range(1, longest + 1):
        done = open_.where(F.col("at") == end).select(F.lit(hop).alias("hops"), "path")
        out = done if out is None else out.unionByName(done)
        if hop < longest:
            more = open_.where(F.col("at") != end).join(links, F.col("at") == F.col("src"))
            open_ = durable(more.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
    return out


def clusters(edges: DataFrame, least: int = 3) -> DataFrame:
    """cluster, size, central (highest degree, then smallest): connected components by minimum labels with pointer jumps, until no label changes."""
    links = durable(undirected(edges))
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    while True:
        near = links.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = durable(step.join(jump, "new").select("node", F.least("new", "far").alias("label"), "old"))
        labels = step.select("node", "label")
        if not step.where("label <> old").limit(1).count():
            break
    degree = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rows = labels.join(degree, "node").groupBy(F.col("label").alias("cluster"))
    return rows.agg(F.count(F.lit(1)).alias("size"), F.max_by("node", F.struct("degree", -F.col("node"))).alias("central")).where(F.col("size") >= least)


def cited_per_year(edges: DataFrame, years: DataFrame) -> DataFrame:
    """node, year, citations: by the citing document's year (G2, G3); years: node, year."""
    return edges.join(years.select(F.col("node").alias("src"), "year"), "src").groupBy(F.col("dst").alias("node"), "year").agg(F.count(F.lit(1)).alias("citations"))


def milestones(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """node, citations: the most cited share of nodes, ties included."""
    cited = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("citations"))
    bound = value_at(cited, "citations", [1 - share])[0]
    return cited.where(F.col("citations") >= bound).select("node", "citations")


def together(rows: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """a, b, weight: members that share at least `least` groups, a < b.

    Members of fewer groups can't reach that and make no pairs: in a crowded group most are such.
    """
    one = rows.select(F.col(group).alias("g"), F.col(member).alias("a")).distinct()
    if least > 1:
        able = one.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a")
        one = one.join(able, "a", "left_semi")
    parts = _parts(rows, group)
    pairs = one.repartition(parts, "g").join(one.select("g", F.col("a").alias("b")).repartition(parts, "g"), "g").where("a < b")
    return pairs.select("a", "b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


#: Pairs a task.
TASK_PAIRS = 1_000_000


def _parts(rows: DataFrame, group: str) -> int:
    """Tasks for the pairs of all groups, so that the memory of one stays the same however many pairs there are."""
    n = F.count(F.lit(1)).cast("double")
    sizes = rows.groupBy(group).agg(n.alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    most = max(x or 0.0 for x in sizes)
    return int(min(max(rows.sparkSession.sparkContext.defaultParallelism, most // TASK_PAIRS + 1), 20_000))


def centrality(links: DataFrame, top: int = 10) -> DataFrame:
    """node, degree, weight, rank of the best linked nodes of together()."""
    ends = links.select(F.col("a").alias("node"), "weight").unionByName(links.select(F.col("b").alias("node"), "weight"))
    rows = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight")).orderBy(F.desc("degree"), F.desc("weight"), "node").limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), F.desc("weight"), "node")))


def citation_stats(edges: DataFrame, papers: DataFrame, as_of: int, recent: int = 2) -> DataFrame:
    """node, years, citations, references, velocity, recent, own: of each paper (G2); papers: node, year, authors.

    velocity: citations a year since publication, the first year counted as one. recent: by papers of the last years up to as_of.
    own: by papers that share an author. A citation counts once; papers without any have zeros, citations by unknown papers count
    in total alone.
    """
    links = edges.select("src", "dst").where("src <> dst").distinct()
    cited = links.join(papers.select(F.col("node").alias("dst"), F.col("authors").alias("_b")), "dst")
    by = papers.select(F.col("node").alias("src"), F.col("year").alias("_year"), F.col("authors").alias("_a"))
    met = cited.join(by, "src", "left")
    late = F.col("_year").between(as_of - recent + 1, as_of)
    shared = F.arrays_overlap(F.array_compact("_a"), F.array_compact("_b"))
    inward = met.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("citations"), F.count_if(late).alias("recent"), F.count_if(shared).alias("own"))
    outward = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("references"))
    rows = papers.select("node", (as_of - F.col("year")).alias("years")).join(inward, "node", "left").join(outward, "node", "left").na.fill(0, ["citations", "recent", "own", "references"])
    return rows.select("node", "years", "citations", "references", (F.col("citations") / F.greatest("years", F.lit(1))).alias("velocity"), "recent", "own")
