"""Queries of ranked search over documents and vectors."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import search as S
from granary.plans.registry import query, table
from granary.session import shared_folder

_TERMS = ["inered", "thering", "license", "version"]
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_BM25 = f"""d AS (SELECT doc_id AS id, source, {_TOK} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT unnest({_TERMS!r}) AS term), f AS (SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q WHERE list_contains(t, term)),
i AS (SELECT term, count(*) AS df FROM f GROUP BY 1), k AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM f JOIN i USING (term), s GROUP BY 1)"""


#: The index of a table's present files, by application, folder and the files' state.
_indexes: dict[tuple, str] = {}


def _index(spark: SparkSession, sf_dir: str) -> S.Index:
    """The index over titles and texts, written to the shared folder when a table is first searched, and again if its files change."""
    d = table(spark, sf_dir, "documents")
    files = d.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*files.columns))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *state)
    if key not in _indexes:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        S.write_index(d, "doc_id", {"title": T.title_of(F.col("text")), "text": F.col("text")}, path)
        _indexes[key] = path
    return S.read_index(spark, _indexes[key])


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.indexed(_index(spark, sf_dir), "text", dict.fromkeys(_TERMS, 1.0))


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM k ORDER BY round(score, 6) DESC, id LIMIT 20")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over whole texts, from stored postings."""
    return S.page(_keyword(spark, sf_dir).select("id", F.round("score", 6).alias("score")), 20)


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM k ORDER BY round(score, 6) DESC, id LIMIT 20")
def scanned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a scan, for tables without an index."""
    found = S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS)
    return S.page(found.select("id", F.round("score", 6).alias("score")), 20)


_FIELDS = """f AS (SELECT doc_id AS id, 'title' AS field, 3.0 AS boost, regexp_extract_all(lower(trim(regexp_extract(text, '^([^.\\n]*)', 1))), '[\\p{L}\\p{N}_]+') AS t FROM documents UNION ALL SELECT doc_id, 'text', 1.0, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') FROM documents),
s AS (SELECT field, count(*) AS n, avg(len(t)) AS mean FROM f GROUP BY 1), o AS (SELECT field, boost, id, len(t) AS dl, unnest(t) AS term FROM f), p AS (SELECT field, boost, id, dl, term, count(*) AS tf FROM o GROUP BY ALL), v AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL)"""
_FUZZY = """q AS (SELECT unnest(['license', 'versoin']) AS asked), e AS (SELECT asked, term, df, levenshtein(term, asked) AS edits FROM v, q WHERE field = 'text' AND regexp_full_match(term, '[a-z0-9_]+') AND abs(length(term) - length(asked)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY df DESC, term) AS i FROM e WHERE edits BETWEEN 1 AND 2), w AS (SELECT term, max(x) AS w FROM (SELECT asked AS term, 1.0::DOUBLE AS x FROM q UNION ALL SELECT term, 1 - edits / least(length(asked), length(term)) FROM r WHERE i <= 50) GROUP BY 1)"""


@query(f"""WITH {_FIELDS}, {_FUZZY}, b AS (SELECT field, id, sum(w * boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS x FROM p JOIN v USING (field, term) JOIN w USING (term) JOIN s USING (field) GROUP BY ALL),
m AS (SELECT id, max(x) AS x FROM b GROUP BY 1), h AS (SELECT id, x + CASE WHEN source = 'src3' THEN 2.5 ELSE 0 END AS x FROM m JOIN documents ON doc_id = id WHERE lang IN ('en', 'de'))
SELECT id, round(x, 6) AS score, (SELECT count(*) FROM h) AS total FROM h ORDER BY round(x, 6) DESC, id LIMIT 15 OFFSET 5""")
def search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with boosts, fuzzy terms, a clause on the author's field, a filter, a page and the exact total (R1, F16, F19, F34, SC1, T1, T2)."""
    index, d = _index(spark, sf_dir), table(spark, sf_dir, "documents")
    plain = replace(index, vocabulary=index.vocabulary.where(F.col("term").rlike("^[a-z0-9_]+$")))  # SQL counts edits by bytes
    best = S.indexed_best_fields(index, {"title": 3.0, "text": 1.0}, S.fuzzy_weights(plain, "text", ["license", "versoin"]))
    author = d.where("source = 'src3'").select(F.col("doc_id").alias("id"), F.lit(2.5).alias("score"))
    both = S.add_scores(best, author.join(best.select("id"), "id", "left_semi"))
    rounded = both.select("id", F.round("score", 6).alias("score"))  # so that copies tie
    return S.request(rounded, d, "doc_id", F.col("lang").isin("en", "de"), size=15, offset=5)


@query(f"WITH {_BM25} SELECT id, round(score + CASE WHEN source = 'src3' THEN 2.5 ELSE 0 END, 6) AS score FROM k JOIN d USING (id) ORDER BY 2 DESC, id LIMIT 20")
def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second clause adds to the score of the hits."""
    d = table(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").alias("id"), F.lit(2.5).alias("score"))
    k = _keyword(spark, sf_dir)
    both = S.add_scores(k, d.join(k.select("id"), "id", "left_semi"))
    return S.page(both.select("id", F.round("score", 6).alias("score")), 20)


_COS = "v AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS c FROM embeddings)"


@query(f"WITH {_COS} SELECT vec_id AS id, round(c, 6) AS similarity FROM v WHERE c + 1 >= 1.1 ORDER BY round(c, 6) DESC, vec_id LIMIT 25")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with a least score."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    found = S.semantic(e, "vec_id", "embedding", q, 0.1).select("id", F.round("similarity", 6).alias("similarity"))
    return found.orderBy(F.desc("similarity"), "id").limit(25)


@query(f"WITH {_BM25}, {_COS} SELECT id, round(score * 0.5 + coalesce(c + 1, 0) * 0.5, 6) AS score FROM k LEFT JOIN v ON vec_id = id ORDER BY 2 DESC, id LIMIT 20")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits by both scores."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()[0]
    both = S.hybrid(_keyword(spark, sf_dir), S.semantic(e, "vec_id", "embedding", q))
    return S.page(both.select("id", F.round("score", 6).alias("score")), 20)


@query("""WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_id AS id, round(value * (1 + 0.3 * greatest(0, 1 - (epoch_us(t) - epoch_us(ts)) / 1000 / 63072000000.0)), 6) AS score FROM events, m ORDER BY 2 DESC, 1 LIMIT 20""")
def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer rows gain up to 30 percent."""
    e = table(spark, sf_dir, "events")
    newest = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return S.page(e.select(F.col("event_id").alias("id"), F.round(S.recency(F.col("value"), F.col("ts"), newest), 6).alias("score")), 20)


@query("""WITH t AS (SELECT DISTINCT p_type AS title, CASE WHEN starts_with(lower(p_type), 'standard') THEN 0 ELSE levenshtein(substr(lower(p_type), 1, 8), 'standard') END AS edits FROM part) SELECT title, CAST(edits AS INT) AS edits FROM t WHERE edits <= 2 ORDER BY edits, title LIMIT 10""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by prefix, and near it."""
    return S.suggest(table(spark, sf_dir, "part"), "p_type", "standard", 10)


@query(f"""WITH d AS (SELECT doc_id AS id, unnest({_TOK}) AS term FROM documents), p AS (SELECT term, id, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT term, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM p JOIN f USING (term), n WHERE id = 7 ORDER BY w DESC, term LIMIT 12)
SELECT id, round(sum(w), 6) AS score FROM p JOIN q USING (term) WHERE id <> 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share the weightiest terms of one."""
    d = table(spark, sf_dir, "documents")
    return S.indexed_more_like(_index(spark, sf_dir), d, "doc_id", F.col("text"), "text", 7).select("id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS id, list_cosine_similarity(a, CAST(embedding AS DOUBLE[])) AS c FROM q JOIN embeddings ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rank FROM s WHERE c > 0.2) SELECT query, id, round(c, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of each query row, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    out = S.neighbours(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", least=0.2)
    return out.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("""SELECT doc_id, regexp_replace(text, '(?i)\\b(license|version)\\b', '<em>\\1</em>', 'g') AS marked FROM documents WHERE regexp_matches(lower(text), '\\b(license|version)\\b')""")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their terms marked."""
    from granary.functions.text import highlighted

    d = table(spark, sf_dir, "documents").where(F.lower("text").rlike(r"\b(license|version)\b"))
    return d.select("doc_id", highlighted(F.col("text"), ["license", "version"]).alias("marked"))
