"""Ranked search over a table of documents (R1-R9, Z1, J9, F12, F15, F16): keywords by BM25, vectors, both, suggestions, similar documents.

write_index() stores postings (field, term, id, tf, len) in buckets of terms, a vocabulary with document frequencies, and
the corpus numbers; a query's few terms are a partition filter and a pushed-down predicate, so that a search reads what it
needs of a bucket. bm25() scores by a scan instead, for tables without an index. Scores follow the published BM25 form with
k1 = 1.2 and b = 0.75. Every ranking ends with the id, so pages are stable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import TOKEN, tokens

K1, B = 1.2, 0.75
#: Fixed values of the recency boost: its share, and the age in milliseconds at which it ends.
RECENCY_SHARE, RECENCY_MS = 0.3, 63072000000


#: Term buckets of an index; a bucket is a folder.
BUCKETS = 32


@dataclass(frozen=True)
class Index:
    """What write_index() stored: postings (field, term, id, tf, len, bucket), vocabulary (field, term, df, bucket), numbers by field."""

    postings: DataFrame
    vocabulary: DataFrame
    numbers: dict[str, tuple[int, float]]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counts(t: Column) -> Column:
    """(term, tf) of a sorted array of tokens: where the runs of equal ones end, and how far apart."""
    ends = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~F.get(t, i - 1).eqNullSafe(F.get(t, i)))
    runs = F.zip_with(ends, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))), lambda e, before: F.struct(F.get(t, e - 1).alias("term"), (e - before).alias("tf")))
    return F.when(F.size(t) > 0, runs)


def write_index(docs: DataFrame, id_col: str, fields: dict[str, Column], path: str) -> None:
    """Tokenises each field once and counts a text's terms in its own row; postings are shuffled once, by term bucket and part of the ids, so a common word is several tasks."""
    each = F.array(*(F.struct(F.lit(name).alias("field"), F.array_sort(tokens(text)).alias("t")) for name, text in fields.items()))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(each).alias("e")).select("id", "e.field", "e.t")
    counts = rows.select("id", "field", F.size("t").alias("len"), F.explode(_counts(F.col("t"))).alias("c")).select("id", "field", "len", "c.term", "c.tf")
    parts = max(1, -(-docs.rdd.getNumPartitions() // 8))
    counts = counts.withColumn("bucket", _bucket(F.col("term")))
    counts = counts.repartition(BUCKETS * parts, "bucket", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("bucket", "field", "term", "id")
    counts.select("field", "term", "id", "len", "tf", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    vocabulary = stored.groupBy("bucket", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    vocabulary.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/vocabulary")
    lengths = stored.groupBy("field").agg(F.sum("tf").alias("tokens")).withColumnRenamed("field", "f")
    names = docs.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    names.join(total).join(lengths, F.col("field") == F.col("f"), "left").select("field", "n", (F.coalesce("tokens", F.lit(0)) / F.greatest("n", F.lit(1))).alias("mean")).write.parquet(f"{path}/numbers")  # a row a field


def read_index(spark: SparkSession, path: str) -> Index:
    numbers = {r.field: (r.n, r["mean"]) for r in spark.read.parquet(f"{path}/numbers").collect()}
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"), numbers)


def _of_terms(table: DataFrame, field: str, terms: Sequence[str]) -> DataFrame:
    """The rows of a few terms: their buckets' folders only, then the terms."""
    buckets = sorted({((h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)) % BUCKETS for t in terms})  # as _bucket
    return table.where(F.col("bucket").isin(buckets) & (F.col("field") == field) & F.col("term").isin(list(terms)))


def indexed(index: Index, field: str, terms: dict[str, float]) -> DataFrame:
    """id, score of the documents with one of the terms, each term's part times its weight."""
    n, mean = index.numbers.get(field, (0, 0.0))
    weights = {t.lower(): w for t, w in terms.items()}
    if not weights:
        return index.postings.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    rows = _of_terms(index.postings, field, sorted(weights))
    known = F.broadcast(_of_terms(index.vocabulary, field, sorted(weights)).select("term", "df"))  # a row a term
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("term")]
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf").cast("double")
    part = weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(mean or 1.0))))
    return rows.join(known, "term").groupBy("id").agg(F.sum(part).alias("score"))


def indexed_best_fields(index: Index, boosts: dict[str, float], terms: dict[str, float]) -> DataFrame:
    """id, score: the best of the fields' boosted scores (F16)."""
    parts = [indexed(index, f, {t: w * boost for t, w in terms.items()}) for f, boost in boosts.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(F.max("score").alias("score"))


def fuzzy_weights(index: Index, field: str, terms: Sequence[str], most: int = 50) -> dict[str, float]:
    """Each term and its variants of the vocabulary (fuzzy_terms), the `most` commonest of a term; a variant weighs less by its share of edits."""
    out = {t.lower(): 1.0 for t in terms}
    for term in sorted(out):
        near = fuzzy_terms(index.vocabulary.where(F.col("field") == field), term).where(F.col("edits") > 0)
        for r in near.orderBy(F.desc("df"), "term").limit(most).collect():
            out[r.term] = max(out.get(r.term, 0.0), 1 - r.edits / min(len(term), len(r.term)))
    return out


def indexed_more_like(index: Index, docs: DataFrame, id_col: str, text: Column, field: str, doc_id: object, size: int = 5, most_terms: int = 12) -> DataFrame:
    """id, score: the documents that share most of this one's weightiest terms (R7); the terms come from its text, all else from the index.

    Scores have six places, so that copies tie.
    """
    n, _ = index.numbers[field]
    own = docs.where(F.col(id_col) == doc_id).select(F.explode(tokens(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("own"))
    known = index.vocabulary.where(F.col("field") == field).join(F.broadcast(own), "term")  # one document's words
    weight = F.col("own") * F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    top = {r.term: r.w for r in known.select("term", weight.alias("w")).orderBy(F.desc("w"), "term").limit(most_terms).collect()}
    if not top:
        return index.postings.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    weights = F.create_map(*(F.lit(x) for pair in top.items() for x in pair))
    rows = _of_terms(index.postings, field, sorted(top)).where(F.col("id") != doc_id)
    return rows.groupBy("id").agg(F.round(F.sum(weights[F.col("term")]), 6).alias("score")).orderBy(F.desc("score"), "id").limit(size)


def request(scored: DataFrame, docs: DataFrame, id_col: str, where: Column | None = None, sort: str = "relevance", date: str | None = None, size: int = 10, offset: int = 0) -> DataFrame:
    """A page of a search with its total: id, score, total of the hits that pass the filter, by relevance, date-desc or date-asc (F10, F34, T1, T2, SC1)."""
    found = docs if where is None else docs.where(where)
    hits = scored.join(found.select(F.col(id_col).alias("id"), *([F.col(date).alias("_date")] if date else [])), "id")
    orders = {"relevance": [F.desc("score")], "date-desc": [F.desc_nulls_last("_date")], "date-asc": [F.asc_nulls_last("_date")]}
    rows = hits.orderBy(*orders[sort], "id")
    rows = (rows.offset(offset) if offset else rows).limit(size)
    return rows.join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total")))).select("id", "score", "total")  # one row


def _counted(text: Column, term: str) -> Column:
    """How often the term is a token of the lower-case text; texts without the substring aren't scanned."""
    return F.when(text.contains(term), F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(term)}(?![\p{{L}}\p{{N}}_])"))).otherwise(F.lit(0))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str], boost: float = 1.0) -> DataFrame:
    """id, score of the documents with one of the terms.

    One pass gives the corpus numbers (a row), a second one scores; a document's counts of the few terms are columns,
    so nothing is exploded or shuffled.
    """
    wanted = sorted({t.lower() for t in terms})
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    size = F.regexp_count(low, F.lit(TOKEN))
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where(F.lit(False))
    n, mean, *df = docs.select(size.alias("len"), *(_counted(low, w).alias(f"tf{i}") for i, w in enumerate(wanted))).agg(F.count(F.lit(1)), F.avg("len"), *(F.count_if(F.col(f"tf{i}") > 0) for i in range(len(wanted)))).first()
    hits = docs.where(reduce(lambda a, b: a | b, [low.contains(w) for w in wanted])).select(F.col(id_col).alias("id"), size.alias("len"), *(_counted(low, w).cast("double").alias(f"tf{i}") for i, w in enumerate(wanted)))

    def part(i: int) -> Column:
        tf = F.col(f"tf{i}")
        idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df[i] + 0.5) / (F.lit(float(df[i])) + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(mean or 1.0))))

    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(wanted))], F.lit(0.0))
    return hits.select("id", (score * boost).alias("score")).where(F.col("score") > 0)


def best_fields(docs: DataFrame, id_col: str, fields: dict[str, float], terms: Sequence[str]) -> DataFrame:
    """id, score: the best of the fields' boosted scores (F16)."""
    parts = [bm25(docs, id_col, f, terms, boost) for f, boost in fields.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(F.max("score").alias("score"))


def fuzzy_terms(vocabulary: DataFrame, term: str) -> DataFrame:
    """Terms of the vocabulary within 0, 1 or 2 edits, for lengths up to 2, up to 5, and more (F16)."""
    edits = 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2
    return vocabulary.where(F.abs(F.length("term") - len(term)) <= edits).withColumn("edits", F.levenshtein(F.col("term"), F.lit(term.lower()))).where(F.col("edits") <= edits)


def add_scores(*parts: DataFrame) -> DataFrame:
    """id, score: sums over parts, as OR clauses add up."""
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(F.sum("score").alias("score"))


def recency(score: Column, date: Column, as_of: Column) -> Column:
    """score, up to RECENCY_SHARE more the newer the date."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / 1000
    return score * (1 + RECENCY_SHARE * F.greatest(F.lit(0.0), 1 - F.coalesce(age, F.lit(float(RECENCY_MS))) / RECENCY_MS))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def semantic(vectors: DataFrame, id_col: str, vector_col: str, query: Sequence[float], least: float = 0.0) -> DataFrame:
    """id, score (cosine + 1) at or above least + 1 if least is positive, and similarity."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("similarity")).where("similarity is not null")
    rows = rows.withColumn("score", F.col("similarity") + 1)
    return rows.where(F.col("score") >= least + 1) if least > 0 else rows


def hybrid(keyword: DataFrame, meaning: DataFrame, keyword_weight: float = 0.5, meaning_weight: float = 0.5) -> DataFrame:
    """id, score: of the keyword hits, the weighted sum of both scores."""
    k, m = keyword.select("id", F.col("score").alias("k")), meaning.select("id", F.col("score").alias("m"))
    return k.join(m, "id", "left").select("id", (F.col("k") * keyword_weight + F.coalesce("m", F.lit(0.0)) * meaning_weight).alias("score"))


def page(scored: DataFrame, size: int = 10, offset: int = 0) -> DataFrame:
    """The rows of a page, best first, then by id."""
    rows = scored.orderBy(F.desc("score"), "id")
    return (rows.offset(offset) if offset else rows).limit(size)


def suggest(titles: DataFrame, title_col: str, prefix: str, size: int = 5) -> DataFrame:
    """Titles that begin with the prefix, or whose beginning is near it; exact ones first."""
    low, p = F.lower(F.col(title_col)), prefix.lower()
    edits = 0 if len(p) <= 2 else 1 if len(p) <= 5 else 2
    off = F.when(low.startswith(p), 0).otherwise(F.levenshtein(F.substring(low, 1, len(p)), F.lit(p)))
    return titles.select(F.col(title_col).alias("title"), off.alias("edits")).where(F.col("edits") <= edits).distinct().orderBy("edits", "title").limit(size)


#: Queries, and rows, that are compared at a time.
QUERY_BLOCK, ROW_BLOCK = 4096, 512


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, least: float = 0.7, size: int = 10) -> DataFrame:
    """query, id, similarity, rank: of a stated set of query rows, each one's nearest rows but itself.

    The queries are broadcast in blocks of QUERY_BLOCK, each compared with all rows in matrix products of at most ROW_BLOCK
    rows; a task keeps its best `size` of each query, and one merge per query ranks them. A further block reads the rows
    once more.
    """
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema, found = "query long, id long, similarity double", []
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).orderBy("query").collect()
        names = np.array([r.query for r in block], np.int64)
        table = np.array([r.v for r in block], np.float64).reshape(len(names), -1)
        found.append(rows.mapInArrow(_nearest(vectors.sparkSession.sparkContext.broadcast((names, table)), least, size), schema))
    every = reduce(lambda a, b: a.unionByName(b), found)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _nearest(shared, least: float, size: int):
    """Of each batch of rows, the best of each query; shared: ids and vectors of the queries."""

    def unit(m: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table = shared.value
        own = unit(table)
        if not len(key):
            return
        for batch in (whole.slice(at, ROW_BLOCK) for whole in batches for at in range(0, whole.num_rows, ROW_BLOCK)):
            listed = batch.column(1).to_pylist()
            keep = [i for i, v in enumerate(listed) if v is not None and len(v) == own.shape[1]]
            if not keep:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[keep]
            near = own @ unit(np.array([listed[i] for i in keep], np.float64)).T
            near[key[:, None] == ids[None, :]] = -2
            a, b = np.nonzero(near > least)
            order = np.lexsort((ids[b], -np.round(near[a, b], 9), a))
            a, b = a[order], b[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)  # among the query's own
            a, b = a[place < size], b[place < size]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(ids[b]), pa.array(near[a, b])], ["query", "id", "similarity"])

    return run
