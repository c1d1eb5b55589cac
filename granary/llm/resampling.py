"""Importance resampling towards a target distribution of hashed word n-grams.

Features are the 1- to `most`-grams of a text's words (letters, digits and all beyond ASCII; A-Z in lower case), counted
in buckets by crc32. A bucket's gain is the log of its smoothed share in the target over that in the raw texts; a
document's weight is the floored mean of its features' gains. Weight plus seeded Gumbel noise, highest first, draws
documents without replacement in proportion to their importance.

Scale: only DataFrame functions. Both corpora are exploded into buckets and counted with map-side sums, so a task sends one row
a bucket. The gain table has one row a bucket (`buckets`, a parameter, at every size) and is broadcast. Documents are summed
after a map-side sum, so a document of any length sends one row. One sort by range over narrow rows, on score and id together,
orders all documents; a rank is the place in its partition plus the rows of the partitions before, so no task sees a whole group.

Defined cases: a null or wordless text has no features, weight 0 and is too short to be drawn; a null id takes the noise of the
empty string and sorts first among ties; rows that repeat an id are scored and ranked each; without target rows gains follow from
the smoothing alone; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import as_row, checkpointed, stored

BUCKETS, MOST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: monotonically_increasing_id: the partition above, the row's place in it below.
_PLACE_BITS = 33


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _NO_WORD, -1), "")


def n_grams(words: Column, most: int) -> Column:
    """All runs of 1 to `most` words, joined by a space."""
    runs, grams = [words], words
    for n in range(2, most + 1):
        left = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), left), F.slice(words, F.lit(n), left), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(grams)
    return F.concat(*runs)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, most: int, name: str) -> DataFrame:
    """(bucket, <name>): how many features of all texts fall into each bucket that has any."""
    words = texts.select(words_of(F.col(f"`{text_col}`")).alias("words"))  # a column of its own, so that it is made once
    each = words.select(F.explode(n_grams(F.col("words"), most)).alias("feature"))
    return each.groupBy((F.crc32("feature") % buckets).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def gain_table(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * log ratio of the smoothed shares)."""
    raw, wanted = bucket_counts(docs, text_col, buckets, most, "s"), bucket_counts(target, target_col, buckets, most, "t")
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").alias("bucket"))
    counts = every.join(raw, "bucket", "left").join(wanted, "bucket", "left").na.fill(0, ["s", "t"])
    counts = checkpointed(counts)  # one row a bucket
    all_raw, all_wanted = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + F.lit(1.0)) * F.lit(float(all_raw + buckets)) / ((F.col("s") + F.lit(1.0)) * F.lit(float(all_wanted + buckets)))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key in thousandths, from the first 32 bits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weights(rows: DataFrame, gains: DataFrame, text: Column, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """(uid, id, n_words, n_features, weight) of rows (uid, id, and what `text` needs)."""
    words = rows.select("uid", "id", words_of(text).alias("words"))
    grams = words.select("uid", "id", F.size("words").cast("long").alias("n_words"), n_grams(F.col("words"), most).alias("grams"))
    each = grams.select("uid", "id", "n_words", F.explode_outer("grams").alias("feature"))
    each = each.select("uid", "id", "n_words", (F.crc32("feature") % buckets).alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    sums = each.groupBy("uid").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("total"))
    mean = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0))  # floors go down
    return sums.select("uid", "id", "n_words", "n_features", mean.cast("long").alias("weight"))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (uid, id, n_words, n_features, weight, score) with rank: the place of the drawn rows, null for others.

    Of the N rows with enough words, floor(percent * N / 100) of the highest score are drawn, ties to the smaller id.
    """
    may = scored.withColumn("may", F.col("n_words") >= least_words)
    order = may.orderBy(F.col("may").desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), "uid")
    placed = stored(order.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", _PLACE_BITS)).withColumn("place", F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_if("may").alias("eligible"))  # one row a partition
    parts = checkpointed(parts)
    drawn = percent * (parts.agg(F.sum("eligible")).first()[0] or 0) // 100
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    out = placed.join(F.broadcast(offsets), "part")
    return out.select(*scored.columns, F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))


def _resampled(rows: DataFrame, gains: DataFrame, most: int, buckets: int, percent: int, least_words: int, seed: int) -> DataFrame:
    found = weights(rows, gains, F.col("text"), most, buckets)
    return ranked(found.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, most: int = MOST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of docs: its id, n_words, n_features, weight, score, and rank if it is drawn."""
    gains = gain_table(docs, target, text_col, target_col, buckets, most)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = _resampled(rows, gains, most, buckets, percent, least_words, seed)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs as struct column `row`, with score and rank. The rows are stored once, under a number of their own."""
    kept = stored(docs.select(F.monotonically_increasing_id().alias("uid"), as_row(docs)))
    settings = {"target_col": "text", "buckets": BUCKETS, "most": MOST, "percent": PERCENT, "least_words": LEAST_WORDS, "seed": SEED} | options
    gains = gain_table(docs, target, text_col, settings.pop("target_col"), settings["buckets"], settings["most"])
    rows = kept.select("uid", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    taken = _resampled(rows, gains, **settings).where(F.col("rank").isNotNull())
    return kept.join(taken.select("uid", "score", "rank"), "uid").select("row", "score", "rank")
