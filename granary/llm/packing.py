"""Packing of documents into token windows by order-preserving dynamic programming.

The token stream of a task's documents, in their order, is cut into windows of at most `window` tokens. Cuts may fall
at document ends (free), at sentence ends (a small penalty) and, only inside stretches of more than `stretch` tokens
without an end, at fixed places there (a large penalty). The cuts minimise padding plus penalties: with S the tokens
before a cut and c its penalty, best(j) = c(j) + min over i of best(i) + window - (S(j) - S(i)), where the minimum
over the i with S(j) - S(i) <= window is the head of a monotone queue; a window whose length is a power of two needs
no padding, which adds one transition for each power that is long enough to be of use. Windows keep all ids, so nothing is truncated away.

Scale: narrow, no shuffle. Tasks stream over their partition and solve a stretch of `chunk` tokens at a time; the last
window of a chunk is not closed but opens the next one.

Defined cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed each; a null doc_id is
kept as null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import small_batches, task_id_base
from granary.llm.tokens import default_tokenizer, word_tokens

WINDOW, END_ID = 4096, 2
#: Penalties in tokens of padding, for a cut at a sentence's end and inside one, and for each window below the full length.
SENTENCE, INSIDE, SHORT = 4.0, 256.0, 16.0
CHUNK, STRETCH = 1 << 20, 1024
#: Windows of a power of two below the full length have at least 2**SHORTEST tokens.
SHORTEST = 9


def choose_cuts(places: list[int], penalties: list[float], window: int = WINDOW, short: float = SHORT) -> list[int]:
    """Of the places 0 = p0 < p1 < ..., the cuts of least cost from the first to the last, both included.

    No two neighbouring places may be more than a window apart.
    """
    n = len(places)
    where = {p: i for i, p in enumerate(places)}
    powers = [1 << k for k in range(SHORTEST, window.bit_length()) if 1 << k < window]
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])  # indexes with rising best + place
    weight = [0.0] * n
    weight[0] = places[0]
    for j in range(1, n):
        at = places[j]
        while places[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        cost = weight[i] + window - at
        if at - places[i] < window:
            cost += short * (j < n - 1)
        for size in powers:
            k = where.get(at - size)
            if k is not None and best[k] + short < cost:
                i, cost = k, best[k] + short
        best[j], back[j] = cost + penalties[j], i
        weight[j] = best[j] + at
        while queue and weight[queue[-1]] >= weight[j]:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [places[i] for i in reversed(cuts)]


def cut_places(ends: np.ndarray, sentences: np.ndarray, window: int, stretch: int = STRETCH) -> tuple[list[int], list[float]]:
    """Places and penalties for documents that end at `ends` and sentences that end at `sentences` (all rising)."""
    stretch = min(stretch, window)
    cost = np.full(int(ends[-1]) + 1, -1.0)  # by place; most have none
    cost[sentences] = SENTENCE
    cost[ends] = cost[0] = 0.0
    soft = np.flatnonzero(cost >= 0)
    for i in np.flatnonzero(np.diff(soft) > stretch):
        cost[soft[i] + stretch : soft[i + 1] : stretch] = INSIDE
    places = np.flatnonzero(cost >= 0)
    return places.tolist(), cost[places].tolist()


class _Stream:
    """The open documents of a task and what is still to be packed of them."""

    def __init__(self, window: int, base: int, closes: np.ndarray) -> None:
        self.window, self.sequence, self.closes = window, base, closes
        self.docs: list[tuple[object, np.ndarray, int]] = []  # the row's key, all its ids, of which so many are packed
        self.open = 0

    def put(self, key: object, ids: np.ndarray) -> None:
        self.docs.append((key, ids, 0))
        self.open += len(ids)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces (key, start, ids, doc_tokens, sequence_id, offset) of all windows, but for the last one if more may come."""
        if not self.docs:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        cuts = choose_cuts(*cut_places(ends, np.flatnonzero(self.closes[stream]) + 1, self.window), self.window)
        if not last and len(cuts) > 2:
            cuts.pop()
        elif not last:
            return
        else:  # the rest of the task: powers of two as long as they save more padding than a cut inside costs
            while (rest := cuts[-1] - cuts[-2]) & (rest - 1) and self.window - rest > INSIDE:
                cuts.insert(-1, cuts[-2] + (1 << (rest.bit_length() - 1)))
        d, at = 0, 0
        for begin, end in zip(cuts, cuts[1:], strict=False):
            while at < end:
                key, ids, done = self.docs[d]
                take = min(len(ids) - done, end - at)
                yield key, done, ids[done : done + take], len(ids), self.sequence, at - begin
                at += take
                self.docs[d] = (key, ids, done + take)
                d += done + take == len(ids)
            self.sequence += 1
        self.docs = self.docs[d:]
        self.open = len(stream) - at


def _packer(path: str, window: int, end_id: int, chunk: int, fields: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_tokens(path)
        closes = model.ends.copy()
        closes[end_id] = False
        stream, tail = _Stream(window, task_id_base(), closes), np.array([end_id], "<u2")

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            pieces = list(stream.pack(last))
            for at in range(0, len(pieces), 20_000):
                key, start, ids, total, sequence, offset = zip(*pieces[at : at + 20_000], strict=True)
                wide = [x.astype("<u4").tobytes() for x in ids]
                arrays = [pa.array(key, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, [len(x) for x in ids])), pa.array([zlib.crc32(x) for x in wide], pa.int64()), *(pa.array(x, pa.int64()) for x in (total, sequence, offset))]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(wide, pa.binary())] if with_ids else []), fields)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = (c.slice(at, 256).to_pylist() for c in batch.columns)
                for key, ids in zip(keys, model.batch(texts), strict=True):
                    stream.put(key, np.concatenate([np.frombuffer(ids, "<u2"), tail]))
                if stream.open >= chunk:
                    yield from packed(False)
        yield from packed(True)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) ids, unsigned 32-bit little-endian."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    if with_ids:
        schema = schema.add("ids", "binary")
    return small_batches(rows).mapInArrow(_packer(tokenizer or default_tokenizer(), window, end_id, chunk, schema.names, with_ids), schema)
