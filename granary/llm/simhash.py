"""SimHash near-duplicates, found by anchor points of a covering code.

A fingerprint is cut into parts. The anchors of a part are the words of a code: a perfect Hamming code on its first
bits (covering radius 1) with the other bits left free. A fingerprint is replicated to every anchor within covering
radius plus threshold, that is within 2 for a threshold of 1 differing bit a part; each anchor then compares all that
came to it.

TIGHT (64 bits, two parts of 31 + 1 bits, distance 3): one half of any linked pair differs in one bit at most, and its
two sides meet at the nearest anchor of either, so no link is missed. A corpus of more than 10^8 distinct texts wants
more free bits. `covering_for` gives a wider code for documents of a stated similarity (see near_copies.py): there two
sides meet in some part with a stated probability, whatever the number of documents.

Scale: only distinct fingerprints are searched (equal ones link anyway), in rows of a few dozen bytes. An anchor
with more rows than `crowd` is dealt out as pairs of blocks, so that no task holds more than two blocks; each of its
rows is then sent up to MOST_BLOCKS times. What leaves a task is a spanning forest of its links, so a group of copies
gives fewer rows than it has members. Labels come from star contraction on the edge table; nothing but counters comes
to the driver.

Defined cases: a null or wordless text has fingerprint zero and links like any other; a text with fewer words than a
shingle counts as one shingle; repeated rows are rows of their own; a null doc_id takes part but is never the
smallest id unless its component has no other (then component_id is null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import checkpointed, slices, small_batches
from granary.llm.components import components, spanning_forest

SEED = 42
#: So many one-bit counters add up in a byte.
BYTE_FULL = 255
#: The lowest bit of each byte.
LANES = np.uint64(0x0101010101010101)
#: Rows of an anchor above which it is dealt out in blocks.
CROWD = 4096
#: A crowded anchor has at most so many blocks (larger ones, if it has very many rows). Bits of an anchor's number: the anchor, its part, the pair of blocks.
MOST_BLOCKS, PART_BIT, DEAL_BIT = 512, 34, 44
#: So many words of a fingerprint travel with each replica, to be compared there.
CARRIED = 3
#: Comparisons that an anchor makes at once.
AT_ONCE = 1 << 20
#: The list of crowded anchors is broadcast up to so many rows of 12 bytes.
BROADCAST_ROWS = 500_000
#: An odd constant near 2**64 divided by the golden ratio, as usual in integer mixing.
GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Covering:
    """words of 64 bits; parts, each with a Hamming code of `checks` check bits and `free` bits more; links at `distance` bits."""

    words: int
    parts: int
    checks: int
    free: int
    distance: int

    @property
    def coded(self) -> int:
        return (1 << self.checks) - 1

    @property
    def bits(self) -> int:
        return self.coded + self.free

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]

    @property
    def carried(self) -> list[str]:
        return self.columns[:CARRIED]


TIGHT = Covering(words=1, parts=2, checks=5, free=1, distance=3)


#: Chance that a bit differs between fingerprints of two sets of shingles with Jaccard similarity 0.8: the angle of two vectors with cosine 2 J / (1 + J), over pi.
FLIP = math.acos(1.6 / 1.8) / math.pi
#: Chance that 15 bits, of which each differs with chance FLIP, share an anchor within 2 (tests/llm measures it); such bits have 7.6 anchors on average, of 2048.
MEET, ANCHORS = 0.715, 7.6
#: Unrelated documents that a document may meet; beyond that, a code has more free bits and more parts.
STRANGERS = 1 << 15


def covering_for(rows: int, recall: float = 0.99) -> Covering:
    """A code in which two of `rows` documents of similarity 0.8 meet with probability `recall`, and unrelated ones seldom.

    Parts of 15 coded bits; free bits, and with them parts, grow with the logarithm of the number of documents.
    """
    free = 3
    while True:
        parts = math.ceil(math.log(1 - recall) / math.log(1 - MEET * (1 - FLIP) ** free))
        if parts * ANCHORS**2 * rows <= STRANGERS << (11 + free):
            break
        free += 1
    words = max(CARRIED, math.ceil(parts * (15 + free) / 64))
    seen = 64 * CARRIED
    return Covering(words, parts, 4, free, math.ceil(seen * FLIP + 3.2 * math.sqrt(seen * FLIP * (1 - FLIP))))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of each shingle of `width` words in its order, repeats included; of all words, where there are fewer."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in tokens]).tolist()
    starts = [0, *ends]
    ends = ends[width - 1 :] or ends[-1:]
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)], np.uint64)


def majority(hashes: np.ndarray, words: int = 1) -> list[int]:
    """`words` longs: the bits that over half of the hashes have; the first long is over the hashes, the others over mixtures of them."""
    n = len(hashes)
    if not n:
        return [0] * words
    mixed = np.empty((words, n), np.uint64)
    mixed[0] = hashes
    for k in range(1, words):
        x = (hashes + np.uint64(k * GOLDEN % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        mixed[k] = x ^ (x >> np.uint64(32))
    total = np.empty((words, 8, 8), np.int64)  # word, byte, bit
    starts = np.arange(0, n, BYTE_FULL)
    for bit in range(8):  # each byte of a sum counts one bit of up to BYTE_FULL hashes
        lanes = np.add.reduceat((mixed >> np.uint64(bit)) & LANES, starts, axis=1)
        total[:, :, bit] = lanes.astype("<u8").view(np.uint8).reshape(words, -1, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * total.reshape(words, 64) > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprint(text: str | None, width: int, words: int = 1) -> list[int]:
    """The majority bits over all shingles of the text, repeats included."""
    return majority(shingle_hashes(text, width), words)


def _fingerprinter(width: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            prints = np.array([fingerprint(t, width, words) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k]) for k in range(words))], ["id", *(f"f{k}" for k in range(words))])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = 1) -> DataFrame:
    """(id, f0, f1, ...) of every row of docs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"]])
    for k in range(words):
        schema = schema.add(f"f{k}", "long")
    return small_batches(rows).mapInArrow(_fingerprinter(width, words), schema)


def _flips(code: Covering) -> np.ndarray:
    """For each syndrome, what to flip to reach the anchors within distance 2; the nearest comes first, -1 fills up.

    Position p (1 to 2**checks - 1) is bit p - 1, and its syndrome is p.
    """
    free = [1 << (code.coded + i) for i in range(code.free)]
    rows = [[0, *free]]
    for s in range(1, code.coded + 1):
        home = 1 << (s - 1)
        rows.append([home, *(home | f for f in free), *(1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, code.coded + 1) if p != s and p < p ^ s)])
    most = max(map(len, rows))
    return np.array([r + [-1] * (most - len(r)) for r in rows], np.int64)


def anchors(values: np.ndarray, code: Covering) -> tuple[np.ndarray, np.ndarray]:
    """Of each part (an integer of code.bits bits), the anchors within distance 2, and which entries count; the nearest is in column 0."""
    syndrome = np.zeros(len(values), np.int64)
    for k in range(code.checks):
        mask = sum(1 << (p - 1) for p in range(1, code.coded + 1) if p >> k & 1)
        syndrome |= (np.bitwise_count(values & mask).astype(np.int64) & 1) << k
    flips = _flips(code)[syndrome]
    return values[:, None] ^ flips, flips >= 0


def _parts(prints: np.ndarray, code: Covering) -> list[np.ndarray]:
    """The parts of each fingerprint (rows of code.words longs) as integers."""
    bits = np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(len(prints), -1), axis=1)[:, ::-1]
    weights = 1 << np.arange(code.bits, dtype=np.int64)
    return [bits[:, k * code.bits : (k + 1) * code.bits].astype(np.int64) @ weights for k in range(code.parts)]


def _replicator(code: Covering):
    names = ["anchor", "node", *code.carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                node, *prints = (batch.column(k).slice(at, 2000).to_numpy(zero_copy_only=False) for k in range(code.words + 1))
                for k, values in enumerate(_parts(np.stack(prints, axis=1), code)):
                    found, counts = anchors(values, code)
                    owner = np.nonzero(counts)[0]
                    key = (np.int64(k) << PART_BIT) | found[counts]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[owner], *(p[owner] for p in prints[:CARRIED]))], names)

    return run


def near(some: np.ndarray, every: np.ndarray, distance: int) -> np.ndarray:
    """Which fingerprints (rows of words) of `every` differ from each of `some` in at most `distance` bits."""
    words = some.shape[1]
    first = np.bitwise_count(some[:, None, 0] ^ every[None, :, 0])
    if words == 1:
        return first <= distance
    bound = math.ceil(distance / words + 2.5 * math.sqrt(distance / words))  # of one word: far off the mean of any that are near
    out = np.zeros(first.shape, bool)
    a, b = np.nonzero(first <= bound)
    close = np.bitwise_count(some[a] ^ every[b]).sum(axis=1, dtype=np.int64) <= distance
    out[a[close], b[close]] = True
    return out


def _linked(own: np.ndarray, prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one anchor, by their nodes: around the smallest, so that anchors of one group give the same links."""
    out = []
    label = np.arange(len(own))
    at = 0
    while at < len(own) - 1:
        step = max(1, AT_ONCE // (len(own) - at))
        close = np.triu(near(prints[at : at + step], prints[at:], distance), 1)
        for r in np.flatnonzero(close.any(axis=1)).tolist():
            i = at + r
            other = at + np.flatnonzero(close[r])
            other = other[label[other] != label[i]]  # what is joined already is passed over, so a group of near copies costs little more than its size
            if len(other):
                joined, first = np.unique(label[other], return_index=True)
                out += [(int(own[i]), int(own[j])) for j in other[first]]
                label[np.isin(label, joined)] = label[i]
        at += step
    return out


def _linker(code: Covering):
    """Rows sorted by anchor (and block pair): a spanning forest of the links that a task's groups have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            key, node, *prints = rest
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
            table = np.stack(prints, axis=1).view(np.uint64)
            pairs: list[tuple[int, int]] = []
            full = np.flatnonzero(ends - starts > 1)
            for a, b in zip(starts[full].tolist(), ends[full].tolist(), strict=True):
                if b < len(key) or last:
                    pairs += _linked(node[a:b], table[a:b], code.distance)
            if not last:
                rest = [x[starts[-1] :] for x in rest]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            here = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = here if rest is None else [np.concatenate(x) for x in zip(rest, here, strict=True)]
            if len(rest[0]):
                yield from groups(False)
        if rest is not None and len(rest[0]):
            yield from groups(True)

    return lambda batches: spanning_forest(run(batches))


def links(prints: DataFrame, code: Covering = TIGHT, crowd: int = CROWD) -> DataFrame:
    """(a, b): of the pairs of nodes (columns node, f0, ...) that link, enough to join all that are linked."""
    schema = "anchor long, node long, " + ", ".join(f"{c} long" for c in code.carried)
    rows = prints.select("node", *code.columns).mapInArrow(_replicator(code), schema)
    busy = rows.groupBy(F.col("anchor").alias("spot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    busy = checkpointed(busy.select("spot", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / crowd)).cast("int").alias("blocks")))
    crowds = busy.count()
    if crowds:  # the rows of a crowded anchor go to all pairs of blocks that theirs is in; the pair's number goes above the anchor
        known = F.broadcast(busy) if crowds <= BROADCAST_ROWS else busy
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
        dealt = rows.join(known, F.col("anchor") == F.col("spot"), "left").withColumn("deal", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
        rows = dealt.select(F.col("anchor").bitwiseOR(F.shiftleft(F.col("deal").cast("long"), DEAL_BIT)).alias("anchor"), "node", *code.carried)
    return rows.repartition("anchor").sortWithinPartitions("anchor", "node").mapInArrow(_linker(code), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, code: Covering = TIGHT, crowd: int = CROWD) -> DataFrame:
    """Per row of docs: id, f0, ..., component_id (smallest id of all documents reachable over links, its own included)."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, width, code.words))
    distinct = rows.groupBy(*code.columns).agg(F.min("id").alias("first"))
    distinct = checkpointed(distinct.withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(distinct, code, crowd))
    parts = checkpointed(distinct.join(roots, "node", "left").select(*code.columns, "first", F.coalesce("root", "node").alias("root")))
    least = checkpointed(parts.groupBy("root").agg(F.min("first").alias("component_id")))  # materialised, so that adaptive execution can split the join with a large component
    return rows.join(parts.join(least, "root").select(*code.columns, "component_id"), code.columns).select("id", *code.columns, "component_id")
