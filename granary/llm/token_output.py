"""Token-id output: best-fit-decreasing packing into matrix rows, written as binary columns.

Documents are encoded, documents longer than a row are split without loss, and the pieces are packed longest first,
each into the open row with the least room that still holds it; a segment tree over the room left finds that row in
as many steps as the row length has bits. A matrix row holds its ids (padded), its cumulative segment lengths and its
position ids, which start anew with each segment.

Scale: narrow, no shuffle. A task packs `chunk` tokens of its partition at a time, so memory doesn't grow with it; the
rows' numbers carry the task's number above. Files are written by Spark as Parquet, so a lost task is simply repeated.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import small_batches, task_id_base
from granary.llm.tokens import default_tokenizer, word_tokens

LENGTH, END_ID, PAD_ID = 4096, 2, 0
CHUNK = 1 << 20

SCHEMA = T.StructType(
    [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("input_ids", T.BinaryType()),
        T.StructField("position_ids", T.BinaryType()),
    ]
)


class RoomTree:
    """Segment tree over rooms 0 to limit: how many open rows have each, and the least room of at least a wanted one."""

    def __init__(self, limit: int) -> None:
        self.size = 1 << limit.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, wanted: int) -> tuple[int, int] | None:
        """The room and the number of a row with the least room of at least `wanted`, which leaves the tree."""
        at = wanted + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has rows
                at >>= 1
            if at == 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.count[2 * at])
        room = at - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of indexes into lengths (each 1 to limit), longest first and of equal ones the earlier first."""
    tree, bins = RoomTree(limit), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[i])
        room, row = found if found else (limit, len(bins))
        if not found:
            bins.append([])
        bins[row].append(i)
        tree.put(room - lengths[i], row)
    return bins


def _writer(path: str, length: int, end_id: int, pad_id: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = word_tokens(path), task_id_base()
        tail = np.array([end_id], "<u2")
        pieces: list[tuple[object, int, np.ndarray]] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = []
            for members in best_fit_decreasing([len(x) for _, _, x in pieces], length):
                parts = [pieces[i] for i in members]
                ids = np.full(length, pad_id, "<u4")
                places = np.zeros(length, "<u4")
                ends = np.cumsum([len(x) for _, _, x in parts])
                for (_, _, x), end in zip(parts, ends.tolist(), strict=True):
                    ids[end - len(x) : end] = x
                    places[end - len(x) : end] = np.arange(len(x))
                rows.append({"sequence_id": number, "n_tokens": int(ends[-1]), "doc_ids": [k for k, _, _ in parts], "starts": [s for _, s, _ in parts], "cu_seqlens": [0, *ends.tolist()], "input_ids": ids.tobytes(), "position_ids": places.tobytes()})
                number += 1
            for at in range(0, len(rows), 200):
                yield pa.RecordBatch.from_pylist(rows[at : at + 200], schema=ARROW)
            pieces.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = (c.slice(at, 256).to_pylist() for c in batch.columns)
                for key, ids in zip(keys, model.batch(texts), strict=True):
                    whole = np.concatenate([np.frombuffer(ids, "<u2"), tail])
                    for start in range(0, len(whole), length):
                        pieces.append((key, start, whole[start : start + length]))
                    held += len(whole)
                    if held >= chunk:
                        yield from packed()
                        held = 0
        yield from packed()

    return run


ARROW = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])


def token_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, pad_id: int = PAD_ID, chunk: int = CHUNK) -> DataFrame:
    """One row per matrix row: sequence_id, n_tokens, doc_ids and starts of its segments, cu_seqlens, input_ids and position_ids.

    input_ids and position_ids are `length` unsigned 32-bit little-endian integers; starts counts a document's ids before the segment.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(_writer(tokenizer or default_tokenizer(), length, end_id, pad_id, chunk), SCHEMA)


def write_matrix(matrix: DataFrame, path: str) -> DataFrame:
    """Writes the rows of token_matrix under path and returns what was written; numpy.frombuffer(row.input_ids, '<u4') reads a row."""
    matrix.write.option("compression", "zstd").parquet(path)
    return matrix.sparkSession.read.schema(SCHEMA).parquet(path)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for number, docs, starts, ends, ids, places in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            ids, places = np.frombuffer(ids, "<u4"), np.frombuffer(places, "<u4")
            for doc, start, a, b in zip(docs, starts, ends, ends[1:], strict=False):
                out.append((doc, start, b - a, zlib.crc32(ids[a:b].tobytes()), number, a, bool((places[a:b] == np.arange(b - a)).all())))
        if not out:
            continue
        kinds = [pa.int64()] * 6 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset", "positions_reset"])


def segments(matrix: DataFrame) -> DataFrame:
    """Reads the binary columns back: doc_id, start, length, ids_crc32, sequence_id, offset, positions_reset of each segment."""
    return matrix.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids").mapInArrow(_segments, "doc_id long, start long, length long, ids_crc32 long, sequence_id long, offset long, positions_reset boolean")
