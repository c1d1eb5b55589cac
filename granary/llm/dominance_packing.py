"""Packing into as few sequences as possible: the dominance reduction of Martello and Toth, then best-fit for the rest.

Pieces of equal length are interchangeable, so the instance is a count of pieces by length: `limit` numbers at every size of the
corpus. The reduction takes the lengths from the longest. Of a length w and k, how many of the smallest pieces fit beside it:
a piece that nothing fits beside stands alone; the longest partner that fits fixes the pair if it fills the sequence exactly or
if k = 1; for k = 2 it fixes the pair if it is no shorter than the best two together, or fixes the best three if the partner is the
longer of the two and no other two between could do better. Each such set dominates every other set with w, so some best packing has
it. The rounds go on with what is left until nothing more is fixed. The rest is packed best-fit-decreasing. All steps work on
many equal pieces at once, so the plan's size follows the number of lengths, not of pieces.

Scale: texts are encoded once, in place, into a stored table of pieces; pieces that fill a sequence are fixed there. The others get
a rank among those of equal length (a count by task and length, summed over the tasks, plus the place within the task), and the
plan, broadcast, gives each rank its sequence and offset. No task gathers a length's pieces; the driver sees the counts only.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are packed each; a null id is kept; ids keep
their type; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import ID_BITS, checkpointed, small_batches, stored, task_id_base
from granary.llm.tokens import default_tokenizer, word_tokens

LIMIT, END_ID = 2048, 0


@dataclass
class Pattern:
    """`times` sequences of one content: runs of (length, how many), and the room left."""

    times: int
    room: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def _best_two(count: list[int], room: int) -> tuple[int, int]:
    """Lengths a >= b of two pieces with the largest sum up to room; (0, 0) if no two fit."""
    have = [w for w in range(1, room) if count[w]]
    best, low, high = (0, 0), 0, len(have) - 1
    while low <= high:
        a, b = have[high], have[low]
        if a + b > room:
            high -= 1
        elif low == high:
            return (a, a) if count[a] > 1 and 2 * a > sum(best) else best
        else:
            best = max(best, (a, b), key=sum)
            low += 1
    return best


def _two_between(count: list[int], a: int, b: int) -> int:
    """The least sum of two pieces strictly longer than b and shorter than a; 0 if there are not two."""
    least = [w for w in range(b + 1, a) for _ in range(min(count[w], 2))][:2]
    return sum(least) if len(least) == 2 else 0


def _smallest_beside(count: list[int], room: int) -> int:
    """How many of the smallest pieces fit into room, 3 standing for more."""
    n = 0
    for w in range(1, room + 1):
        take = min(count[w], room // w, 3 - n)
        n, room = n + take, room - take * w
        if n == 3 or take < count[w]:
            break
    return n


def _partners(count: list[int], w: int, limit: int) -> tuple[int, ...] | None:
    """The pieces that dominate all others beside one of length w (itself taken out of count); None if no rule tells."""
    room = limit - w
    longest = next((x for x in range(min(room, limit), 0, -1) if count[x]), 0)
    if not longest:
        return ()
    fit = _smallest_beside(count, room)
    if fit == 1 or longest == room:
        return (longest,)
    if fit == 2:
        a, b = _best_two(count, room)
        if longest >= a + b:
            return (longest,)
        if a == longest and not 0 < _two_between(count, a, b) <= room:
            return (a, b)
    return None


def reduce_by_dominance(count: list[int], limit: int) -> list[Pattern]:
    """Takes the sets that dominate their alternatives out of count (by length, 0 to limit) and returns them."""
    fixed, again = [], True
    while again:
        again = False
        for w in range(limit, 0, -1):
            while count[w]:
                count[w] -= 1
                beside = _partners(count, w, limit)
                count[w] += 1
                if beside is None:
                    break
                members = (w, *beside)
                each = {x: members.count(x) for x in members}
                times = min(count[x] // n for x, n in each.items())
                for x, n in each.items():
                    count[x] -= n * times
                fixed.append(Pattern(times, limit - sum(members), list(each.items())))
                again = True
    return fixed


def best_fit_decreasing(count: list[int], limit: int) -> list[Pattern]:
    """All pieces of count, longest first, each into the sequence with the least room that still holds it; equal ones at once."""
    open_: list[list[Pattern]] = [[] for _ in range(limit + 1)]

    def put(times: int, room: int, runs: list[tuple[int, int]]) -> None:
        if times:
            open_[room].append(Pattern(times, room, runs))

    for w in range(limit, 0, -1):
        left, room = count[w], w
        while left and room <= limit:
            if not open_[room]:
                room += 1
                continue
            p = open_[room].pop()
            full = room // w  # pieces that a sequence takes before another one fits better
            many, rest = divmod(left, full)
            many = min(many, p.times)
            put(many, room - full * w, [*p.runs, (w, full)])
            left -= many * full
            if many < p.times and left:  # fewer than a sequence's share are left
                put(1, room - rest * w, [*p.runs, (w, rest)])
                many, left = many + 1, 0
            put(p.times - many, room, p.runs)
        if left:
            full = limit // w
            many, rest = divmod(left, full)
            put(many, limit - full * w, [(w, full)])
            if rest:
                put(1, limit - rest * w, [(w, rest)])
    return [p for same in open_ for p in same]


def plan(count: list[int], limit: int) -> list[Pattern]:
    """Patterns that hold each of the counted pieces once: the dominating sets, then best-fit-decreasing for the rest."""
    left = list(count)
    return reduce_by_dominance(left, limit) + best_fit_decreasing(left, limit)


def places(patterns: list[Pattern], limit: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where runs of equal pieces begin by rank, how many a sequence has, the first sequence, and the offset there."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for p in patterns:
        at = 0
        for w, n in p.runs:
            runs.setdefault(w, []).append((n * p.times, n, base, at))
            at += n * w
        base += p.times
    out = {}
    for w, found in runs.items():
        total, each, first, at = np.array(found, np.int64).T
        out[w] = (np.cumsum(total) - total, each, first, at)
    return out


def _cutter(path: str, limit: int, end_id: int, with_ids: bool):
    """Pieces of a task's documents, numbered by their length; task and number together tell each from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, base = word_tokens(path), task_id_base()
        task, seen = base >> ID_BITS, [0] * (limit + 1)
        tail = np.array([end_id], "<u2")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, out, wide = [], [], []
                for row, ids in enumerate(model.batch(part.column(1).to_pylist())):
                    whole = np.concatenate([np.frombuffer(ids, "<u2"), tail]).astype("<u4")
                    for number, start in enumerate(range(0, len(whole), limit)):
                        data = whole[start : start + limit].tobytes()
                        n = len(data) // 4
                        owner.append(row)
                        out.append((number, start, n, zlib.crc32(data), seen[n]))
                        seen[n] += 1
                        if with_ids:
                            wide.append(data)
                if not out:
                    continue
                piece, start, length, crc, nth = zip(*out, strict=True)
                arrays = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, [task] * len(out), nth))]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(wide, pa.binary())] if with_ids else []), ["doc", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])])

    return run


def _placer(shared, limit: int):
    """Rows with columns length, task, nth, before (the last two may be null for full pieces): adds sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            length, task, nth, before = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "task", "nth", "before"))
            full = length == limit
            sequence = np.where(full, ((task + 1) << ID_BITS) + nth, 0)
            offset = np.zeros(len(length), np.int64)
            for w in np.unique(length[~full]).tolist():
                starts, each, first, at = found[w]
                here = np.flatnonzero(length == w)
                rank = before[here] + nth[here]
                run_ = np.searchsorted(starts, rank, "right") - 1
                inside = rank - starts[run_]
                sequence[here] = first[run_] + inside // each[run_]
                offset[here] = at[run_] + inside % each[run_] * w
            kept = [c for c in batch.schema.names if c not in ("task", "nth", "before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*kept, "sequence_id", "offset"])

    return run


def pack_fewest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces: the id, piece, start, length, ids_crc32, sequence_id, offset and (with_ids) ids, unsigned 32-bit little-endian."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("piece", T.IntegerType())])
    for name in ("start", "length", "ids_crc32", "task", "nth"):
        schema = schema.add(name, "long")
    if with_ids:
        schema = schema.add("ids", "binary")
    pieces = stored(small_batches(rows).mapInArrow(_cutter(tokenizer or default_tokenizer(), limit, end_id, with_ids), schema))
    by_task = pieces.where(F.col("length") < limit).groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = checkpointed(by_task)  # one row a task and length
    count = [0] * (limit + 1)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # one row a length
        count[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(count, limit), limit))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ready = pieces.join(before, ["length", "task"], "left").select(*pieces.columns, F.coalesce("before", F.lit(0)).cast("long").alias("before"))
    out = T.StructType([f for f in schema if f.name not in ("task", "nth")]).add("sequence_id", "long").add("offset", "long")
    placed = ready.mapInArrow(_placer(shared, limit), out)
    return placed.select(F.col("doc").alias(id_col), *(c for c in placed.columns if c != "doc"))
