"""Exact deduplication by block naming.

Texts (A-Z lower-cased, UTF-8) are cut into blocks of a fixed number of bytes. Sorting the blocks gives every
distinct block an integer name; then names of adjacent pairs are named in turn, level by level, until each
document has one name. Names stand for contents, never for hashes of them, so that equal identities mean equal texts.

Scale: the whole text is shuffled once, as blocks, after each task has removed the blocks it has met before (so a
text that a third of all rows share crosses the network once per task). All later levels move integers only.

Defined cases: a null text counts as empty; an empty text is one empty block; rows that repeat a doc_id are rows of
their own, and of several rows with the group's largest doc_id exactly one is kept; a null doc_id ranks below all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, small_batches, stored, task_id_base

BLOCK_BYTES = 4096
#: Bytes of blocks that a task remembers to leave out repeats before the shuffle.
SEEN_BYTES = 32 << 20

_CUT = "uid long, doc_id long, sha string, gids array<long>, gid long, block binary"
_NAMED = "gid long, name long"


def _cutter(block_bytes: int, seen_bytes: int):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("gids", pa.list_(pa.int64())), ("gid", pa.int64()), ("block", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = task_id_base()
        seen: dict[bytes, int] = {}
        held = uid = gid = 0
        for batch in batches:
            docs, blocks = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode().lower()
                gids = []
                for at in range(0, len(data) or 1, block_bytes):
                    block = data[at : at + block_bytes]
                    known = seen.get(block)
                    if known is None:
                        if held > seen_bytes:
                            seen.clear()
                            held = 0
                        known = seen[block] = base + gid
                        gid += 1
                        held += len(block) + 100
                        blocks.append({"gid": known, "block": block})
                    gids.append(known)
                docs.append({"uid": base + uid, "doc_id": doc_id, "sha": hashlib.sha256(data).hexdigest(), "gids": gids})
                uid += 1
            yield pa.RecordBatch.from_pylist(docs + blocks, schema=schema)

    return cut


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: each run of equal blocks gets the next integer."""
    base, last, name = task_id_base(), None, -1
    for batch in batches:
        names = []
        for block in batch.column(1).to_pylist():
            if block != last:
                last, name = block, name + 1
            names.append(base + name)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], ["gid", "name"])


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, seen_bytes: int = SEEN_BYTES) -> DataFrame:
    """One row per row of docs: uid, doc_id, sha, and its identity (level, name); equal identity, equal text."""
    cut = stored(small_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))).mapInArrow(_cutter(block_bytes, seen_bytes), _CUT))
    blocks = cut.where("block is not null").select("gid", "block")
    names = checkpointed(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_name_runs, _NAMED))
    rows = cut.where("uid is not null").select("uid", "gids")
    current = checkpointed(rows.select("uid", F.size("gids").alias("n"), F.posexplode("gids").alias("pos", "gid")).join(names, "gid").select("uid", "n", "pos", "name"))
    longest = current.agg(F.max("n")).first()[0] or 0
    level, done = 0, current.where("n = 1").select("uid", F.lit(0).alias("level"), "name")
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = current.where("n > 1").groupBy("uid", F.expr("pos div 2").cast("int").alias("pos")).agg(F.expr("cast(ceil(max(n) / 2) as int)").alias("n"), F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("l"), F.expr("coalesce(max(if(pos % 2 = 1, name, null)), -1)").alias("r"))
        pairs = checkpointed(pairs)
        names = checkpointed(pairs.groupBy("l", "r").agg(F.lit(1)).sortWithinPartitions("l", "r").select("l", "r", F.monotonically_increasing_id().alias("name")))
        current = checkpointed(pairs.join(names, ["l", "r"]).select("uid", "n", "pos", "name"))
        done = done.unionByName(current.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))
    return cut.where("uid is not null").select("uid", "doc_id", "sha").join(done, "uid")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, keep_id (largest doc_id of its group), group_size, kept, text_sha256."""
    named = checkpointed(identities(docs, id_col, text_col, block_bytes))
    groups = checkpointed(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "uid")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    return named.join(groups, ["level", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"))
