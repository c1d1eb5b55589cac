"""Line deduplication with two Bloom filters.

Pass 1 sends a 64-bit hash of every line key that is long enough, at most two of each from a slab of texts, to a task that
owns a range of hashes. There a once-seen Bloom filter marks each hash that comes again as a suspect. The suspects, far
fewer than the lines, make the twice-seen filter, which is merged in blocks and broadcast. Pass 2 sends only the keys that
this filter holds; they are counted exactly, and the occurrence that stays is chosen.

A filter has no false negatives, so the result is exact at any size: `max_filter_bytes` bounds what is broadcast, and
a fuller filter only sends more suspects to the exact count. The once-seen filters are never broadcast: there are as many
as the corpus needs at FILTER_LINES lines each. The keys found often are broadcast if they are at most `max_key_bytes` in
all, and the last pass is then a map; else each document's share of them is joined to it.

Defined cases: a null or empty text is one empty line; every row is a document of its own (repeated rows count); all
rows of the largest doc_id that holds a key keep their lines; a null doc_id ranks below all. A doc_id is compared in its own
type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import SPACE, as_row, checkpointed, slices, small_batches, stored

MIN_CHARS, MIN_DOCS = 40, 5
BITS_PER_LINE, PROBES = 12, 4
#: A once-seen filter is for so many lines, and of at least so many bits.
FILTER_LINES, LEAST_BITS = 1 << 22, 1 << 21
MAX_FILTER_BYTES, MAX_KEY_BYTES = 64 << 20, 32 << 20
#: The parts of the twice-seen filter are merged in blocks of so many bytes.
BLOCK = 1 << 18
#: Hashes of which a task sends at most two each.
SLAB = 1 << 17


def line_key(line: str) -> str:
    """The line without white space at both ends, A-Z in lower case."""
    return line.strip(SPACE).encode().lower().decode()


def _keys(text: str, min_chars: int) -> dict[str, int]:
    """Distinct keys of a text's lines that are long enough, with their hashes."""
    out = {}
    for line in text.split("\n"):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and key not in out:
                out[key] = xxhash.xxh3_64_intdigest(key)
    return out


def _bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Positions in the filter, one row per hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(n_bits - 1)


def _has(bloom: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((bloom[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _add(bloom: np.ndarray, bits: np.ndarray) -> None:
    flat = bits.ravel()
    np.bitwise_or.at(bloom, flat >> np.uint64(3), np.left_shift(np.uint8(1), (flat & np.uint64(7)).astype(np.uint8)))


def _power(lines: int) -> int:
    """Bits of a filter for so many lines, a power of two."""
    return max(LEAST_BITS, 1 << max(0, BITS_PER_LINE * lines - 1).bit_length())


def _hasher(min_chars: int):
    """The hashes of a task's lines, at most two of each in a slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def out() -> pa.RecordBatch:
            found, counts = np.unique(np.array(held, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(found, np.minimum(counts, 2)).view(np.int64))], ["h"])

        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        held.extend(_keys(text, min_chars).values())
                if len(held) > SLAB:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def _once(n_bits: int):
    """The hashes that come a second time, by a once-seen filter over the task's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            hashes, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            bits = _bits(hashes, n_bits)
            again = (counts > 1) | _has(once, bits)
            _add(once, bits)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[again].view(np.int64))], ["h"])

    return run


def _builder(n_bits: int):
    """A filter of the task's hashes, in compressed blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            _add(bloom, _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n_bits))
        pack = zstandard.ZstdCompressor(level=1).compress
        for at in range(0, n_bits // 8, BLOCK):
            if bloom[at : at + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([at // BLOCK], pa.int32()), "bits": pa.array([pack(bloom[at : at + BLOCK].tobytes())])})

    return build


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the filter of all tasks."""
    unpack = zstandard.ZstdDecompressor().decompress
    part = bits = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([bits.tobytes()])})

    for batch in batches:
        for number, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = np.frombuffer(unpack(more), np.uint8)
            if number == part:
                bits |= more
            else:
                if part is not None:
                    yield out()
                part, bits = number, more.copy()
    if part is not None:
        yield out()


def twice_seen(texts: DataFrame, min_chars: int = MIN_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES, filter_lines: int = FILTER_LINES) -> np.ndarray:
    """texts (text) to a filter that holds every key found in two documents or more."""
    most = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // min_chars  # lines that are long enough
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // filter_lines))
    hashes = texts.mapInArrow(_hasher(min_chars), "h long").repartition(tasks, F.shiftright("h", 40))
    suspects = checkpointed(hashes.mapInArrow(_once(_power(min(filter_lines, most))), "h long").distinct())
    n_bits = min(_power(suspects.count()), max(LEAST_BITS, 8 * max_filter_bytes))
    parts = suspects.coalesce(4 * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(_builder(n_bits), "part int, bits binary")
    merged = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, "part int, bits binary")
    bloom = np.zeros(n_bits // 8, np.uint8)
    for part, bits in merged.toLocalIterator():
        bloom[part * BLOCK : (part + 1) * BLOCK] = np.frombuffer(bits, np.uint8)
    return bloom


def _suspected(shared, min_chars: int):
    """Rows (first columns, text last): the first columns and each key that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = np.frombuffer(shared.value, np.uint8)
        for batch in (part for whole in batches for part in slices(whole)):
            keys, hashes, owner = [], [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = _keys(text, min_chars) if text else {}
                keys += found
                hashes += found.values()
                owner += [row] * len(found)
            if keys:
                hit = np.flatnonzero(_has(bloom, _bits(np.array(hashes, np.uint64), 8 * len(bloom)))).tolist()
                rows = pa.array([owner[k] for k in hit], pa.int64())
                columns = [c.take(rows) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([keys[k] for k in hit], pa.string())], [*batch.schema.names[:-1], "key"])

    return run


def _without(text: str | None, gone) -> tuple[str, int, int]:
    """The text without the lines whose key is gone, the number of lines, and of those that go."""
    every = (text or "").split("\n")
    rest = [x for x in every if not gone(x)]
    return "\n".join(rest), len(every), len(every) - len(rest)


def _results(rows: pa.Array, found: list[tuple[str, int, int]]) -> pa.RecordBatch:
    kept, lines, dropped = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([rows, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept_text", "n_lines", "n_dropped"])


def _dropper(shared, min_chars: int):
    """Rows (row, doc, text), with a broadcast of the frequent keys and the doc in which each stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            found = []
            for doc, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(_without(text, lambda line, doc=doc: len(line) >= min_chars and stays.get(line_key(line), doc) != doc))
            yield _results(batch.column(0), found)

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, drop), drop being the keys that go."""
    for batch in (part for whole in batches for part in slices(whole)):
        found = []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys = frozenset(drop or ())
            found.append(_without(text, lambda line, keys=keys: bool(keys) and line_key(line) in keys))
        yield _results(batch.column(0), found)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_filter_bytes: int = MAX_FILTER_BYTES, max_key_bytes: int = MAX_KEY_BYTES) -> DataFrame:
    """docs as struct column `row`, with kept_text, n_lines (before) and n_dropped.

    Keys of at least min_chars code points found in at least min_docs documents lose all their lines but those in
    the largest doc_id that holds the key.
    """
    text, doc = F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("doc")
    bloom = twice_seen(small_batches(docs.select(text)), min_chars, max_filter_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(bloom.tobytes())
    some = docs.select(doc, text)
    kind = some.schema["doc"].dataType
    keys = some.mapInArrow(_suspected(shared, min_chars), T.StructType([T.StructField("doc", kind), T.StructField("key", T.StringType())]))
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("stays")).where(F.col("docs") >= min_docs)
    often = checkpointed(often.select("key", "stays"))
    source = docs.select(as_row(docs), doc, text)
    results = T.StructType([source.schema["row"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if (often.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0) <= max_key_bytes:
        held = docs.sparkSession.sparkContext.broadcast(dict(often.toLocalIterator()))
        return source.mapInArrow(_dropper(held, min_chars), results)
    rows = stored(source.withColumn("uid", F.monotonically_increasing_id()))
    fields = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc", kind), T.StructField("key", T.StringType())])
    lines = rows.select("uid", "doc", "text").mapInArrow(_suspected(shared, min_chars), fields)
    drops = lines.join(often, "key").where(~F.col("doc").eqNullSafe(F.col("stays"))).groupBy("uid").agg(F.collect_list("key").alias("drop"))
    return rows.join(drops, "uid", "left").select("row", "text", "drop").mapInArrow(_finish, results)
