"""Queries of nested buckets, the vector index and the relations of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import analytics, filters
from granary.operators import bucket_tree as B
from granary.operators import landscape as S
from granary.operators import linking as K
from granary.operators import vector_index as V
from granary.plans.registry import query, table
from granary.session import shared_folder


@query("""WITH a AS (SELECT l_linestatus AS k1, count(*) AS n, sum(l_linenumber) AS lines, row_number() OVER (ORDER BY count(*) DESC, l_linestatus) AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 4),
b AS (SELECT l_linestatus AS k1, l_returnflag AS k2, count(*) AS n, sum(l_linenumber) AS lines, row_number() OVER (PARTITION BY l_linestatus ORDER BY count(*) DESC, l_returnflag) AS rank FROM lineitem WHERE l_linestatus IN (SELECT k1 FROM a) GROUP BY 1, 2 QUALIFY rank <= 2),
c AS (SELECT l_linestatus AS k1, l_returnflag AS k2, CAST(l_suppkey AS VARCHAR) AS k3, count(*) AS n, sum(l_linenumber) AS lines, row_number() OVER (PARTITION BY l_linestatus, l_returnflag ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem WHERE (l_linestatus, l_returnflag) IN (SELECT (k1, k2) FROM b) GROUP BY l_linestatus, l_returnflag, l_suppkey QUALIFY rank <= 3)
SELECT 1 AS level, k1 AS path, rank, n, CAST(lines AS BIGINT) AS lines FROM a UNION ALL SELECT 2, k1 || ' > ' || k2, rank, n, CAST(lines AS BIGINT) FROM b UNION ALL SELECT 3, k1 || ' > ' || k2 || ' > ' || k3, rank, n, CAST(lines AS BIGINT) FROM c""")
def nested_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of three levels with sums, the best of each, flattened to rows."""
    rows = table(spark, sf_dir, "lineitem").withColumn("lines", F.col("l_linenumber").cast("long"))
    tree = B.bucket_tree(rows, ["l_linestatus", "l_returnflag", "l_suppkey"], [4, 2, 3], ["lines"])
    return B.flattened(tree, 3, ["lines"])


def _index(spark: SparkSession, vectors: DataFrame) -> V.VectorIndex:
    n = vectors.count()
    return V.write_index(vectors, "vec_id", "embedding", f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", lists=max(4, min(4096, int(n**0.5) // 2)))


@query()
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 20 the ten nearest of all others, by an inverted-file index."""
    vectors = table(spark, sf_dir, "embeddings")
    index = _index(spark, vectors)
    return V.search(index, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes=V.probes_for(index, vectors, "vec_id", "embedding"))


@query()
def document_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge table by kind: near vectors of every vector, benchmark passages named in texts, documents that share an identifier with the first that has it."""
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    index = _index(spark, vectors)
    near = V.search(index, vectors, "vec_id", "embedding", 5, probes=V.probes_for(index, vectors, "vec_id", "embedding", 5))
    titles = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "^([^.]*)", 1).alias("title"))
    named = K.named_in(docs, "doc_id", "text", titles, "item_id", "title")
    near = near.select(F.concat(F.lit("v"), "query").alias("src"), F.concat(F.lit("v"), "id").alias("dst"), F.col("similarity").alias("weight"))
    named = named.select(F.concat(F.lit("d"), "text_id").alias("src"), F.concat(F.lit("b"), "title_id").alias("dst"), F.lit(1.0).alias("weight"))
    shared = K.identifier_links(docs.select("doc_id", text.identifiers([F.col("text")]).alias("i")), "doc_id", "i")
    shared = shared.select(F.concat(F.lit("d"), "id").alias("src"), F.concat(F.lit("d"), "class_id").alias("dst"), F.lit(1.0).alias("weight"))
    return V.relations({"similar": near, "names": named, "identifier": shared})


@query()
def landscape_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells between territories of the map of all vectors."""
    scape = S.landscape(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return scape.gaps.select("cx", "cy", F.array_join(F.col("territories").cast("array<string>"), ",").alias("territories"), "near")


@query()
def landscape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain of the map of all vectors."""
    return S.landscape(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").terrain


@query("""WITH c AS (SELECT year(o_orderdate) AS year, o_orderpriority AS entity, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT year(o_orderdate) AS year, count(*) AS total FROM orders GROUP BY 1),
k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC, entity) AS r FROM c QUALIFY r <= 3), b AS (SELECT entity FROM k GROUP BY 1 ORDER BY sum(n) DESC, entity LIMIT 2)
SELECT year, entity, n, total, round(n * 100.0 / total, 1) AS share FROM k JOIN t USING (year) WHERE entity IN (FROM b)""")
def truncated_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by year from lists cut to each year's three largest, as an index with truncated lists gives them (D3)."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("entity"))
    totals = orders.groupBy("year").agg(F.count(F.lit(1)).alias("total"))
    return analytics.shares(orders.groupBy("year", "entity").agg(F.count(F.lit(1)).alias("n")), totals, top=2, per_year=3)


@query("SELECT doc_id, array_to_string(list_filter(['the', 'der', 'que', 'license'], lambda w: list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), w)), ',') AS mentions FROM documents")
def mentioned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the given terms each text has as whole words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.mentions(F.col("text"), ["the", "der", "que", "license"]), ",").alias("mentions"))


@query("SELECT doc_id, contains(lower(text), 'licens') OR contains(lower(source), 'src1') OR contains(lower(lang), 'de') AS relevant FROM documents")
def relevant_by_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of a document by its text or any element of a list."""
    found = filters.relevant_parts([F.col("text")], [F.array("source", "lang")], ["licens", "src1", "de"])
    own = filters.relevant_parts([F.col("text")], [], ["licens"]) | filters.relevant_parts([], [F.array("source")], ["src1"]) | filters.relevant_parts([], [F.array("lang")], ["de"])
    return table(spark, sf_dir, "documents").select("doc_id", (own & found).alias("relevant"))
