"""Quality rules: text statistics, and the log-likelihood ratio of hashed word n-grams between a trusted and the raw corpus.

Only DataFrame functions. Pass 1 counts the hashed 1- and 2-grams of all documents in buckets (each task sends one row a
bucket), and in the same pass those of all trusted documents. Pass 2 is narrow: each document's mean log ratio over its
n-grams is compared with a fixed margin, so the verdict needs neither a random draw nor a rank within the corpus.

Both multinomials cover all of their documents. The table of ratios is a literal of the second pass, which is why it has
BUCKETS entries at every size. The ids of the trusted documents are broadcast up to BROADCAST_ROWS; beyond that they are
joined.

Defined cases: a null or wordless text has zero everywhere and fails the base rules; with no trusted document all
ratios are zero, so the base rules decide; repeated rows count as often as they occur; a null id is never trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed

BUCKETS = 8192
#: Trusted ids are broadcast up to so many.
BROADCAST_ROWS = 2_000_000
#: What is added to the counts.
PSEUDO = 50.0
#: A document stays if its mean log ratio is at least this many nats a n-gram.
MARGIN = -0.05
SPAN = 8
_SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACES, -1), "")


def _pairs(hashes: Column, gap: int) -> Column:
    """Hashes of each element with the one `gap` places on; `gap` elements fewer."""
    n = F.greatest(F.size(hashes) - gap, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))


def _bucket(hashes: Column, buckets: int) -> Column:
    return F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def _covered(spans: Column, n: Column) -> Column:
    """How many words lie in a span (its hash at each start) that occurs twice or more."""
    order = F.sort_array(F.arrays_zip(spans.alias("h"), F.sequence(F.lit(0), n - 1).alias("p")))
    at = F.sequence(F.lit(0), n - 1)

    def twice(s: Column) -> Column:
        def mark(i: Column) -> Column:
            here = F.get(s, i)["h"]
            return F.when(F.coalesce(here == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(here == F.get(s, i + 1)["h"], F.lit(False)), F.get(s, i)["p"])

        return F.sort_array(F.filter(F.transform(at, mark), lambda p: p.isNotNull()))

    def total(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-SPAN).alias("last")), lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(SPAN), p - acc["last"])).alias("sum"), p.alias("last")), lambda acc: acc["sum"])

    # each array is bound once by a one-element transform
    return F.get(F.transform(F.array(order), lambda s: F.get(F.transform(F.array(twice(s)), total), F.lit(0))), F.lit(0))


def statistics(rows: DataFrame, text: Column) -> DataFrame:
    """rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the arrays _hashes and _two of its 1- and 2-gram hashes."""
    out = rows.withColumn("_text", F.coalesce(text.cast("string"), F.lit(""))).withColumn("_words", words_of(F.col("_text")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_two", _pairs(F.col("_hashes"), 1))
    out = out.withColumn("_eight", _pairs(_pairs(F.col("_two"), 2), 4))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    repeated = F.size(F.array_distinct("_eight")) < F.size("_eight")
    return out.select(
        *rows.columns,
        F.size("_words").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _covered(F.col("_eight"), F.size("_eight"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "_hashes",
        "_two",
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of all documents labelled good, outside the held-out fold (crc32 of the id mod 4 is 2)."""
    return labels.where((F.col("quality") == 1) & (F.crc32(F.col(id_col).cast("string")) % 4 != 2)).select(F.col(id_col).alias("_good")).distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, pseudo: float = PSEUDO) -> list[float]:
    """Of each bucket, the log of its share in the trusted over that in the raw n-grams.

    `pseudo` is added to each trusted count, and as much for its size to each raw one, so that a bucket with little
    evidence says little.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), words_of(F.col(f"`{text_col}`").cast("string")).alias("_words"))
    few = trusted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(trusted) if few else trusted, F.col("_id") == F.col("_good"), "left")
    rows = rows.select(F.col("_good").isNotNull().cast("int").alias("good"), F.transform("_words", lambda w: F.xxhash64(w)).alias("one"))
    rows = rows.select("good", F.explode(F.concat(_bucket(F.col("one"), buckets), _bucket(_pairs(F.col("one"), 1), buckets))).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good"))
    counts = checkpointed(counts)  # one row a bucket
    all_raw, all_good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    out = [0.0] * buckets
    if all_good:
        expected = F.col("raw") * F.lit(all_good / all_raw)
        for bucket, ratio in counts.select("bucket", F.log((F.col("good") + pseudo) / (expected + pseudo))).collect():
            out[bucket] = ratio
    return out


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, margin: float = MARGIN) -> DataFrame:
    """Per row of docs: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio."""
    table = F.split(F.lit(",".join(map(repr, log_ratios(docs, trusted, id_col, text_col, buckets)))), ",").cast("array<double>")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = statistics(rows, F.col("text")).drop("text")
    grams = F.size("_hashes") + F.size("_two")

    def total(hashes: str) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))

    ratio = F.when(grams > 0, (total("_hashes") + total("_two")) / grams).otherwise(0.0)
    rows = rows.withColumn("log_ratio", ratio).drop("_hashes", "_two")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("log_ratio") >= margin)).alias("kept"), "log_ratio")
