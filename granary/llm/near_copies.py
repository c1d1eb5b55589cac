"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The search is that of simhash.py: fingerprints over the set's shingles, replicated to the anchors of a covering code that
covering_for() fits to the number of documents. Two documents of similarity 0.8 meet in some part with probability
`recall` (0.99), more similar ones more surely. What an anchor links by fingerprint only gathers candidates into families;
a document is then linked to another of its family if, and only if, the true similarity of their sets is 0.8 or more.

Scale: documents of equal sets are one node, so exact copies cost nothing further. Only documents of a family send their
texts on, once each, to the task that compares the family. A family above `crowd` documents or `bulk` characters is cut into
blocks: each block is compared within itself and with a few hubs (about HUBS documents of the family, chosen by a hash),
which joins a group of near copies at the price of its size. Documents that are then not in the family's largest group are
open: they are dealt to blocks of their own, the others too, and each open block meets itself and every other block in a task
of two blocks, so each pair with an open document is compared once more and no task holds more than two blocks. A family whose
documents share much and are yet below the threshold therefore costs the square of its size, in tasks of bounded size.
Nothing but counters comes to the driver.

Defined cases: a null or wordless text has no shingles, and all such texts are equal; a text with fewer words than a
shingle counts as one shingle; repeats of a shingle count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import as_row, checkpointed, slices, small_batches, stored
from granary.llm.components import components, spanning_forest
from granary.llm.simhash import Covering, covering_for, links, majority, near, shingle_hashes

#: Families above so many documents or characters are cut into blocks of that size; they have about so many hubs.
CROWD, BULK, HUBS = 1024, 32 << 20, 32
#: Shingles that are compared with a document's at once.
AT_ONCE = 1 << 21
#: Within a family, pairs are compared exactly if their fingerprints differ in at most this share of bits: ten standard deviations above the mean at 0.8.
LOOSE = 0.41

#: Materialised tables of up to so many narrow rows are broadcast.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def _digester(width: int, words: int):
    names = ["uid", "n", "chars", "d0", "d1", *(f"f{k}" for k in range(words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            size, chars, digest, prints = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text, width)
                size.append(len(own))
                chars.append(len(text or ""))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(majority(own, words))
            digests, table = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2), np.array(prints, np.int64).reshape(-1, words)
            columns = [batch.column(0), pa.array(size, pa.int32()), pa.array(chars, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(pa.array(table[:, k]) for k in range(words))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _few(df: DataFrame) -> DataFrame:
    """df (materialised), as a broadcast where it is small, so that the other side of a join is not shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _joined(nodes: list[int], own: list[np.ndarray], open_: list[bool], side: list[int]) -> list[tuple[int, int]]:
    """Pairs of similarity 0.8 and more that join all that are linked.

    Left out are pairs of two documents that are not open, and those of one side, unless it is 0.
    """
    prints = np.array([majority(s, 3) for s in own], np.int64).view(np.uint64)
    size, free, of = np.array([len(s) for s in own]), np.array(open_), np.array(side)
    label, out = np.arange(len(own)), []
    bound = int(LOOSE * 64 * prints.shape[1])
    for i in range(len(own) - 1):
        after = slice(i + 1, None)
        may = near(prints[i : i + 1], prints[after], bound)[0] & (label[after] != label[i]) & (5 * np.minimum(size[after], size[i]) >= 4 * np.maximum(size[after], size[i]))
        may &= (free[after] | free[i]) & ((of[after] != of[i]) | (of[i] == 0))
        other = i + 1 + np.flatnonzero(may)
        while len(other):
            many = max(1, int(np.searchsorted(np.cumsum(size[other]), AT_ONCE)))
            some, other = other[:many], other[many:]
            every = np.concatenate([own[j] for j in some])
            at = np.minimum(np.searchsorted(own[i], every), len(own[i]) - 1)
            shared = np.add.reduceat((own[i][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[some])[:-1]]))
            for j in some[9 * shared >= 4 * (size[i] + size[some])].tolist():
                if label[j] != label[i]:
                    out.append((nodes[i], nodes[j]))
                    label[label == label[j]] = label[i]
            other = other[label[other] != label[i]]
    return out


def _comparer(width: int):
    """Rows (family, block, open, side, node, text), sorted by family and block: links within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, own, open_, side = None, [], [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            if pairs := _joined(nodes, own, open_, side) if len(nodes) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

        for batch in (part for whole in batches for part in slices(whole)):
            for family, block, free, of, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (family, block):
                    yield from found()
                    group, nodes, own, open_, side = (family, block), [], [], [], []
                nodes.append(node)
                own.append(shingles(text, width))
                open_.append(free)
                side.append(of)
        yield from found()

    return lambda batches: spanning_forest(run(batches))


def _compared(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """members (node, family, open, blocks: array of (block, side)) and texts (node, text) to (a, b) of similarity 0.8 and more."""
    rows = texts.join(_few(members), "node").select("family", F.explode("blocks").alias("b"), "open", "node", "text")
    rows = rows.select("family", "b.block", "open", "b.side", "node", "text")
    rows = rows.repartition("family", "block").sortWithinPartitions("family", "block", F.desc("open"))
    return checkpointed(small_batches(rows).mapInArrow(_comparer(width), "a long, b long"))


def open_pairs(members: DataFrame, crowd: int, bulk: int) -> DataFrame:
    """members (node, family, chars, open) to the same with blocks: the pairs of blocks in which an open document meets all others once.

    Open documents have blocks 0 to opens - 1, the others the next ones, each of about `crowd` documents or `bulk` characters at most.
    A task is (open block, same or later block); an open block meets itself as side 0, others as two sides.
    """

    def blocks(which: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(which) / crowd), F.ceil(F.coalesce(F.sum(F.when(which, F.col("chars"))), F.lit(0)) / bulk)).cast("long")

    sizes = checkpointed(members.groupBy("family").agg(blocks(F.col("open")).alias("opens"), blocks(~F.col("open")).alias("others")).where("opens > 0"))
    rows = members.join(_few(sizes), "family")
    own = F.when(F.col("open"), F.pmod(F.xxhash64(F.lit(1), "node"), "opens")).otherwise(F.col("opens") + F.pmod(F.xxhash64(F.lit(1), "node"), F.greatest("others", F.lit(1))))
    rows = rows.withColumn("own", own).withColumn("last", F.when(F.col("open"), F.col("opens") + F.col("others")).otherwise(F.col("opens")) - 1)

    def pair(x: Column) -> Column:
        low, high = F.least(x, F.col("own")), F.greatest(x, F.col("own"))
        return F.struct((low * (F.col("opens") + F.col("others")) + high).alias("block"), F.when(low == high, 0).otherwise(F.when(F.col("own") == low, 1).otherwise(2)).alias("side"))

    return rows.select("node", "family", "open", F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), pair).alias("blocks"))


def true_links(families: DataFrame, texts: DataFrame, width: int, crowd: int = CROWD, bulk: int = BULK) -> DataFrame:
    """families (node, family, chars) and texts (node, text) to (a, b): enough of the pairs that are similar to join all that are linked."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    big = checkpointed(sizes.where((F.col("n") > crowd) | (F.col("chars") > bulk)).select("family", F.greatest(F.ceil(F.col("n") / crowd), F.ceil(F.col("chars") / bulk)).cast("int").alias("count"), F.greatest(F.lit(1), F.expr(f"n div {HUBS}")).alias("every")))
    known = families.join(_few(big), "family", "left")
    everywhere = F.sequence(F.lit(0), F.coalesce("count", F.lit(1)) - 1)
    home = F.array(F.pmod(F.xxhash64(F.lit(1), "node"), F.coalesce("count", F.lit(1))).cast("int"))
    alone = lambda blocks: F.transform(blocks, lambda x: F.struct(x.cast("long").alias("block"), F.lit(0).alias("side")))
    hub = F.col("every").isNotNull() & (F.pmod(F.xxhash64("node"), F.col("every")) == 0)
    first = known.select("node", "family", F.lit(True).alias("open"), alone(F.when(hub, everywhere).otherwise(home)).alias("blocks"))
    found = _compared(checkpointed(first), texts, width)
    if not big.count():
        return found
    named = checkpointed(known.where("count is not null").join(components(found), "node", "left").select("node", "family", "chars", F.coalesce("root", "node").alias("root")))
    groups = named.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max(F.struct("n", "root")).alias("most"))
    second = checkpointed(named.join(_few(checkpointed(groups)), "family").withColumn("open", F.col("root") != F.col("most.root")))
    rest = _compared(checkpointed(open_pairs(second, crowd, bulk)), texts, width)
    return found.unionByName(rest)


def near_copies(rows: DataFrame, width: int = 5, recall: float = 0.99, code: Covering | None = None, crowd: int = CROWD) -> DataFrame:
    """rows (uid: long, text: string; read several times) to (uid, root): the smallest uid that each row reaches over links."""
    code = code or covering_for(rows.count(), recall)
    schema = "uid long, n int, chars long, d0 long, d1 long, " + ", ".join(f"{c} long" for c in code.columns)
    prints = checkpointed(small_batches(rows.select("uid", "text")).mapInArrow(_digester(width, code.words), schema))
    nodes = checkpointed(prints.groupBy("n", "d0", "d1", *code.columns).agg(F.min("uid").alias("node"), F.max("chars").alias("chars"), F.count(F.lit(1)).alias("copies")))
    several = checkpointed(nodes.where("copies > 1").select("n", "d0", "d1", F.col("node").alias("same")))
    named = prints.join(_few(several), ["n", "d0", "d1"], "left").select("uid", F.coalesce("same", "uid").alias("node"))
    met = checkpointed(links(nodes.where("n > 0"), code))
    families = components(met).select("node", F.col("root").alias("family"))
    families = checkpointed(families.join(nodes.select("node", "chars"), "node"))
    roots = components(true_links(families, rows.select(F.col("uid").alias("node"), "text"), width, crowd))
    return checkpointed(named.join(_few(checkpointed(roots)), "node", "left").select("uid", F.coalesce("root", "node").alias("root")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """docs without near copies: of each group of linked rows one stays, that with the smallest id (null last).

    Each row counts by itself, whatever its id: rows that repeat an id, or have none, go only as near copies. Of rows
    with the group's smallest id one stays, by a hash of the text.
    """
    rows = stored(docs.select(as_row(docs), F.monotonically_increasing_id().alias("uid")))
    text, doc_id = F.col(f"row.`{text_col}`").cast("string"), F.col(f"row.`{id_col}`")
    found = near_copies(rows.select("uid", text.alias("text")), width)
    shared = _few(checkpointed(found.where("uid <> root").select("root").distinct()))
    grouped = checkpointed(found.join(shared, "root"))  # only these lose rows
    named = rows.select("uid", F.struct(doc_id.isNull(), doc_id, F.xxhash64(text), "uid").alias("rank")).join(_few(grouped), "uid")
    best = named.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.uid").alias("uid"))
    gone = checkpointed(grouped.select("uid").join(_few(checkpointed(best)), "uid", "left_anti"))
    return rows.join(_few(gone), "uid", "left_anti").select("row.*")
