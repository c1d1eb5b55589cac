"""Phrase collocations by language: level-wise mining with hashed bucket counts of the next length (PCY, DHP) and Apriori pruning.

Pass k reads all texts. It counts the k-grams that may be frequent exactly: both their (k-1)-grams are frequent (a table of bits made
from the exact counts of pass k-1) and their bucket, counted in pass k-1, holds at least the least count. In the same scan it counts
buckets of (k+1)-grams whose both k-grams are still possible. Both tables only prune, and err on the side of counting more;
what is frequent is decided by exact counts alone, of the phrases themselves, not of hashes.

A phrase's score is that of its weakest cut: a * n / (l * r) with a its count, l and r those of its two sides and n the words of
the language, in decimals of 38 digits and floored after a factor of 1000. A phrase inside a longer frequent one that is as
frequent (`inside` percent) goes.

Scale: a task works on SLAB words at a time: within a slab, grams get exact integer names by sorting, so Python touches each
distinct possible phrase once, and one row each goes on to Spark's sums, with a map-side part. Bucket counts stop at the least
count (one byte each), are sent as compressed blocks once a task, and are added block by block in streams. The tables of bits
are broadcast: `buckets_for` gives them at most MOST_BUCKETS bits (4 MiB). Beyond some 3 * 10^9 words the buckets fill and prune less;
results stay whole, and Apriori pruning remains. The best phrases of a language are picked by parts first, so no task sees all of them.

Defined cases: a null lang is `und` and joins rows that say so; a null, empty or wordless text adds nothing; repeated rows
count each; a text of any length is worked in parts, so memory follows its words only while it is split; an empty table, and one
without frequent words, give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, slices, small_batches, stored

LONGEST, LEAST, INSIDE, TOP = 5, 100, 100, 2000
LEAST_BUCKETS, MOST_BUCKETS, BLOCK = 1 << 16, 1 << 25, 1 << 16
#: Words that a task works on at a time, bytes of a part of a text, words whose numbers a task keeps.
SLAB, PART, WORDS = 1 << 20, 4 << 20, 500_000
#: Parts of a language in the choice of its best phrases.
SPREAD = 64
#: Numbers up to this are counted in a table rather than by sorting.
MOST_DENSE = 1 << 23

#: A-Z to lower case, tab to space, the marks that end a piece to a byte that UTF-8 doesn't have.
_END = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _END * 10)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _first(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return _mixed(words + langs * _STEP)


def _longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of the grams with one more word behind each."""
    return _mixed(grams * _STEP + words)


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def buckets_for(n_bytes: int) -> int:
    """Buckets for texts of so many bytes: a power of two near a hundredth, between LEAST_BUCKETS and MOST_BUCKETS."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, n_bytes // 100).bit_length()))


class Buckets:
    """Counts by bucket that stop at `least`."""

    def __init__(self, size: int, least: int) -> None:
        self.least = least
        self.kind = np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32
        self.counts = np.zeros(size, self.kind)

    def add(self, hashes: np.ndarray, times: np.ndarray | None = None) -> None:
        at = hashes & np.uint64(len(self.counts) - 1)
        if times is None and len(self.counts) <= min(MOST_DENSE, 16 * len(at)):
            self.counts = np.minimum(np.bincount(at.view(np.int64), minlength=len(self.counts)) + self.counts, self.least).astype(self.kind)
            return
        if times is None:
            at, times = np.unique(at, return_counts=True)
        else:
            at, inverse = np.unique(at, return_inverse=True)
            times = np.bincount(inverse, np.minimum(times, self.least))
        self.counts[at] = np.minimum(self.counts[at].astype(np.int64) + times.astype(np.int64), self.least).astype(self.kind)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for at in range(0, len(self.counts), BLOCK):
            part = self.counts[at : at + BLOCK]
            if part.any():
                yield at // BLOCK, pack(part.tobytes())


def _has(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; where there is no table, all are."""
    if bits is None:
        return np.ones(len(hashes), bool)
    at = hashes & np.uint64(8 * len(bits) - 1)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)


class _Numbers(dict):
    """Bytes of words to numbers; a word not met before gets the next one."""

    def __init__(self) -> None:
        super().__init__({_END: 0})
        self.words, self.hashes = [_END], [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


class _Slab:
    """The words of a task not yet worked on, as numbers (0: a piece's end), with the number of each one's language."""

    def __init__(self) -> None:
        self.known = _Numbers()
        self.langs: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.owners: list[tuple[int, int]] = []
        self.held = 0

    def put(self, lang: str, text: str | None) -> Iterator[None]:
        """Takes a text in parts; yields whenever there is a slab's worth."""
        if not text:
            return
        owner = self.langs.setdefault(lang, len(self.langs))
        data, at = text.encode().translate(_TABLE), 0
        while at < len(data):
            end = data.find(b" ", at + PART) if at + PART < len(data) else -1
            end = len(data) if end < 0 else end
            found = data[at:end].replace(_END, b" \xff ").split()
            if end == len(data):
                found.append(_END)
            self._number(found, owner)
            at = end
            if self.held >= SLAB:
                yield

    def _number(self, found: list[bytes], owner: int) -> None:
        numbers = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        self.parts.append(numbers)
        self.owners.append((owner, len(numbers)))
        self.held += len(numbers)

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, list[str]]:
        """Words, languages, the words' bytes and hashes, the languages' names; the last `keep` words stay for the next slab."""
        numbers = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        owners = np.repeat(*np.array(self.owners, np.int64).reshape(-1, 2).T)
        words, hashes, names = self.known.words, np.array(self.known.hashes, np.uint64), list(self.langs)
        rest, behind = numbers[len(numbers) - keep :], owners[len(owners) - keep :]
        if len(words) > WORDS:
            self.known = _Numbers()
            self.parts, self.owners, self.held = [], [], 0
            for number, owner in zip(rest.tolist(), behind.tolist(), strict=True):
                self._number([words[number]], owner)
        else:
            self.parts, self.owners, self.held = [rest], [(o, 1) for o in behind.tolist()], len(rest)
        return numbers, owners, words, hashes, names


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows given by columns of numbers below sizes: a place of each distinct one, and how often it occurs. Exact, by naming."""
    name, size = columns[0], sizes[0]
    for column, most in zip(columns[1:], sizes[1:], strict=True):
        if size * most >= 1 << 62:
            found, name = np.unique(name, return_inverse=True)
            size = len(found)
        name, size = name * most + column, size * most
    if size <= min(MOST_DENSE, 16 * len(name)):
        counts = np.bincount(name, minlength=size)
        first = np.zeros(size, np.int64)
        first[name] = np.arange(len(name))  # any place of each
        found = np.flatnonzero(counts)
        return first[found], counts[found]
    _, first, counts = np.unique(name, return_index=True, return_counts=True)
    return first, counts


def _grams(k: int, last: int, least: int, size: int, frequent, possible):
    """Pass k over rows (lang, text): exact counts of possible k-grams, and blocks of bucket counts of (k+1)-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter, bucket = (np.frombuffer(x.value, np.uint8) if x is not None else None for x in (frequent, possible))
        slab, buckets = _Slab(), Buckets(size, least) if k < last else None

        def count(keep: int) -> Iterator[pa.RecordBatch]:
            numbers, owners, words, hashes, names = slab.take(min(keep, slab.held))
            own = hashes[numbers]
            langs = np.array([_hash(x.encode()) for x in names], np.uint64)[owners] if names else np.zeros(0, np.uint64)
            may, grams = numbers != 0, _first(own, langs)
            for j in range(2, k):
                grams = _longer(grams[:-1], own[j - 1 :])
                may = may[:-1] & (numbers[j - 1 :] != 0)
            if k > 1:  # here grams are (k-1)-grams
                may &= _has(shorter, grams)
                grams = _longer(grams[:-1], own[k - 1 :])
                may = may[:-1] & may[1:] & _has(bucket, grams)
            starts = np.flatnonzero(may[: max(0, len(numbers) - keep)])
            if buckets is not None and len(grams) > 1:
                both = np.flatnonzero((may[:-1] & may[1:])[: max(0, len(numbers) - keep)])
                buckets.add(_longer(grams[both], own[both + k]))
            if len(starts):
                columns = [owners[starts], *(numbers[starts + j] for j in range(k))]
                first, counts = _distinct(columns, [len(names), *[len(words)] * k])
                of = columns[0][first].tolist()
                phrases = [b" ".join(map(words.__getitem__, row)).decode() for row in zip(*(c[first].tolist() for c in columns[1:]), strict=True)]
                yield _rows([names[i] for i in of], phrases, counts.tolist(), [], [])

        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for _ in slab.put(lang, text):
                        yield from count(last)
        yield from count(0)
        if buckets is not None:
            for block, data in buckets.blocks():
                yield _rows([], [], [], [block], [data])

    return run


_PASS = "lang string, phrase string, n long, block int, counts binary"


def _rows(langs: list, phrases: list, counts: list, blocks: list, data: list) -> pa.RecordBatch:
    gone, none = [None] * len(blocks), [None] * len(langs)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
    columns = [langs + gone, phrases + gone, counts + gone, none + blocks, none + data]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["lang", "phrase", "n", "block", "counts"])


def _adder(least: int, as_bits: bool):
    """Rows (block, counts) of a task to one row for each of its blocks: added up, or as bits of those that reach the least count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        kind, sums = Buckets(1, least).kind, {}
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(unpack(data), kind)
                sums[block] = np.minimum(sums[block] + more.astype(np.int64), least) if block in sums else more.astype(np.int64)
        for block, counts in sums.items():
            data = np.packbits(counts >= least, bitorder="little").tobytes() if as_bits else pack(counts.astype(kind).tobytes())
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([data], pa.binary())})

    return run


def _bits(blocks: DataFrame, size: int, least: int):
    """Broadcast of the bits of the buckets that reach the least count, from rows (block, counts) of all tasks."""
    tasks = min(size // BLOCK, 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    shape = "block int, counts binary"
    halves = blocks.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(8))).repartition(8 * tasks, "block", "salt").select("block", "counts")
    whole = halves.mapInArrow(_adder(least, False), shape).repartition(tasks, "block").mapInArrow(_adder(least, True), shape)
    bits = np.zeros(size // 8, np.uint8)
    for block, data in whole.toLocalIterator():
        part = np.frombuffer(data, np.uint8)
        bits[block * BLOCK // 8 : block * BLOCK // 8 + len(part)] = part
    return blocks.sparkSession.sparkContext.broadcast(bits.tobytes())


def _marker(least: int, size: int):
    """Rows (lang, phrase) of frequent phrases to the blocks of their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size, least)
        for batch in batches:
            for part in slices(batch, 50_000):
                langs, phrases = (c.to_pylist() for c in part.columns)
                rows = [[_hash(w) for w in p.encode().split(b" ")] for p in phrases]
                words = np.array(rows, np.uint64)
                grams = _first(words[:, 0], np.array([_hash(x.encode()) for x in langs], np.uint64))
                for j in range(1, words.shape[1]):
                    grams = _longer(grams, words[:, j])
                buckets.add(grams, np.full(len(grams), least))
        for block, data in buckets.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([data], pa.binary())})

    return run


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words found at least `least` times, and (lang, n), the words of each lang."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = small_batches(texts)
    size = buckets or buckets_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    frequent = possible = totals = None
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        found = stored(texts.mapInArrow(_grams(k, longest, least, size, frequent, possible), _PASS))
        counts = found.where(F.col("phrase").isNotNull()).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = checkpointed(found.where(F.col("phrase").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n")))
        level = counts.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("words"), "f")
        levels.append(level := checkpointed(level))
        if k == longest or not (n := level.count()):
            break
        possible = _bits(found.where(F.col("block").isNotNull()).select("block", "counts"), size, least)
        marked = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (16 * n).bit_length()))
        few = level.select("lang", "phrase").coalesce(docs.sparkSession.sparkContext.defaultParallelism)
        frequent = _bits(few.mapInArrow(_marker(least, marked), "block int, counts binary"), marked, least)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, totals: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words and more that no longer one takes the place of."""
    words = F.split("phrase", " ", -1)
    many = phrases.where(F.col("words") > 1)
    cut = F.col("cut")
    cuts = many.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(words, F.lit(1), cut).alias("left"), _part(words, cut + 1, F.col("words") - cut).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    span = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size"))))))
    inner = many.where(F.col("words") > 2).select("lang", "phrase", "f", span.alias("span"))
    inner = inner.select("lang", _part(words, F.col("span.at"), F.col("span.size")).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    return kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").cast("long").alias("score"))


def best_by_lang(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each lang by score, then a, both descending, then phrase; with rank, from 1."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("salt")
    some = found.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return some.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    phrases, totals = frequent_phrases(docs, lang_col, text_col, longest, least, buckets)
    return best_by_lang(scored(phrases, totals, inside), top)
