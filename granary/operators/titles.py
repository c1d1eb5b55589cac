"""Titles that are nearly the same text (J5, X2): the sequence ratio of Ratcliff and Obershelp, for the best few of those that share most words.

A new title is compared with the `most` known ones of the highest score among those that share `share` of its distinct words.
Known titles that are the same after normalising are one class, so copies can't crowd out others. Pairs that share a word grow
with the square of the input, so none is sent or stored: both sides are dealt to cells, a part of the new titles and a block of
the known ones each, of bounded size. A cell has an index of its block in memory; whoever shares at least m of n words shares at least t of
the n - m + t rarest, so only those lists are merged, some titles at a time. It answers with the best `most` of each new title, as
numbers; the best of all cells are joined with their names if their lengths allow the ratio, and compared in order up to the first that is near enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import normalised
from granary.session import durable

#: The share of words, the number of titles compared, the least ratio.
SHARE, MOST, LEAST = 0.8, 10, 0.85
#: Saturation and length weight of the word score.
K1, B = 1.2, 0.75
#: Characters of known and of new titles in a cell, about; cells at least; entries of lists merged at once; shared words that a pair needs to be looked at.
BLOCK, PART, CELLS, AT_ONCE, SEEN = 24_000_000, 12_000_000, 16, 2_000_000, 2


def ratio_at_least(a: str, b: str, least: float) -> float | None:
    """2 * matching characters / all characters, by longest common blocks, left and right of each in turn; null below `least`."""
    m = SequenceMatcher(None, a, b)  # from 200 characters on, those in over 1 % of b are junk
    if m.real_quick_ratio() < least or m.quick_ratio() < least:
        return None
    ratio = m.ratio()
    return ratio if ratio >= least else None


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ratio_at_least(p, q, least) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def _classes(df: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """number, name, id: a row for each title, numbered in the order of the names. Kept, as numbers have to stay."""
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(title_col)).alias("name")).where("name <> ''")
    classes = rows.groupBy("name").agg(F.min("id").alias("id"))
    return durable(classes.orderBy("name").withColumn("number", F.monotonically_increasing_id()))


def _split(names: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The words of all names, and the row of each."""
    lists = pc.split_pattern(names, " ").combine_chunks()
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten()


def _runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of places, from starts, of counts: the run of each place, and the places."""
    ends = np.cumsum(counts)
    return np.repeat(np.arange(len(counts)), counts), np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours whose sizes add up to `most` about, one at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


class _Block:
    """Known titles in the order of their numbers, and which of them have a word."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("theirs")
        self.numbers, self.names = table["theirs"].to_numpy(), table["name"]
        rows, words = _split(self.names)
        coded = words.dictionary_encode()
        self.words, self.rows = coded.dictionary, len(self.numbers)
        self.long = np.bincount(rows, minlength=self.rows)
        self.keys, self.times = np.unique(rows * max(1, len(self.words)) + coded.indices.to_numpy(), return_counts=True)
        word = self.keys % max(1, len(self.words))
        self.lists = (self.keys // max(1, len(self.words)))[np.argsort(word, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.words)))])

    def has(self, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row has the word, and where its count is."""
        want = rows * len(self.words) + words
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return self.keys[at] == want, at


class _Part:
    """New titles and those of their distinct words that the block has, rarest first: word, df of all known titles; first and many, the place and number of a title's."""

    def __init__(self, table: pa.Table, block: _Block, share: float):
        self.numbers, self.names = table["ours"].to_numpy(), table["name"]
        rows, words = _split(self.names)
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        _, at = np.unique(rows * max(1, len(coded.dictionary)) + code, return_index=True)
        at.sort()  # distinct words in the order in which the title has them, as the dfs are
        rows, word, df = rows[at], pc.fill_null(pc.index_in(coded.dictionary, block.words), -1).to_numpy()[code[at]], table["dfs"].combine_chunks().flatten().to_numpy()
        self.need = np.maximum(1, np.floor(share * np.bincount(rows, minlength=len(self.numbers)) + 1e-9).astype(np.int64))
        held = word >= 0
        rows, word, df = rows[held], word[held].astype(np.int64), df[held]
        size = block.begin[word + 1] - block.begin[word]
        order = np.lexsort((size, rows))
        self.word, self.df, self.size, self.row = word[order], df[order], size[order], rows[order]
        self.many = np.bincount(rows, minlength=len(self.numbers))
        self.first = np.cumsum(self.many) - self.many


def _met(block: _Block, part: _Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of part and block that share enough words, ordered, all of a title at once."""
    able, seen = part.many >= part.need, np.minimum(part.need, SEEN)
    head = np.where(able, part.many - part.need + seen, 0)
    heads = np.flatnonzero(np.arange(len(part.word)) - part.first[part.row] < head[part.row])
    for a, b in _pieces(np.bincount(part.row[heads], part.size[heads], len(head)), AT_ONCE):
        some = heads[slice(*np.searchsorted(part.row[heads], [a, b]))]
        which, at = _runs(block.begin[part.word[some]], part.size[some])
        pairs, hits = np.unique((part.row[some][which] - a) * block.rows + block.lists[at], return_counts=True)
        pairs, hits = pairs[(keep := hits >= seen[pairs // block.rows + a])], hits[keep]
        ours, theirs = pairs // block.rows + a, pairs % block.rows
        whole, done, step = [], np.zeros(len(ours), np.int64), 1  # the other words, a few at a time while enough can still be shared
        while len(ours):
            rest = part.need[ours] - seen[ours]
            take = np.minimum(max(1, min(step, AT_ONCE // len(ours))), rest - done)
            which, at = _runs(part.first[ours] + head[ours] + done, take)
            found, _ = block.has(theirs[which], part.word[at])
            hits, done, step = hits + np.bincount(which[found], minlength=len(ours)), done + take, step * 2
            keep, ended = hits + rest - done >= part.need[ours], done == rest
            whole.append((ours[keep & ended], theirs[keep & ended]))
            ours, theirs, hits, done = (x[keep & ~ended] for x in (ours, theirs, hits, done))
        if whole:
            ours, theirs = (np.concatenate(x) for x in zip(*whole, strict=True))
            order = np.lexsort((theirs, ours))
            yield ours[order], theirs[order]


def _scores(block: _Block, part: _Part, ours: np.ndarray, theirs: np.ndarray, classes: int, usual: float) -> np.ndarray:
    out = []
    for a, b in _pieces(part.many[ours], AT_ONCE):
        which, at = _runs(part.first[ours[a:b]], part.many[ours[a:b]])
        found, place = block.has(theirs[a:b][which], part.word[at])
        which, df, times = which[found], part.df[at[found]], block.times[place[found]]
        length = block.long[theirs[a:b][which]]
        weight = np.log(1 + (classes - df + 0.5) / (df + 0.5)) * times * (K1 + 1) / (times + K1 * (1 - B + B * length / usual))
        out.append(np.bincount(which, weight, b - a))
    return np.round(np.concatenate(out), 6) if out else np.zeros(0)


def _compared(share: float, most: int | None, least: float, classes: int, usual: float):
    def run(new: pa.Table, known: pa.Table) -> pa.Table:
        columns: list[tuple] = [([], [], [], [])]
        if len(new) and len(known):
            block = _Block(known)
            part = _Part(new, block, share)
            own, other = pc.utf8_length(part.names).to_numpy(), pc.utf8_length(block.names).to_numpy()
            for ours, theirs in _met(block, part):
                score = _scores(block, part, ours, theirs, classes, usual)
                order = np.lexsort((theirs, -score, ours))
                ours, theirs, score = ours[order], theirs[order], score[order]
                if most is not None:
                    keep = np.arange(len(ours)) - np.searchsorted(ours, ours) < most
                    ours, theirs, score = ours[keep], theirs[keep], score[keep]
                able = 2 * np.minimum(own[ours], other[theirs]) / (own[ours] + other[theirs]) >= least - 1e-9
                columns.append((part.numbers[ours], block.numbers[theirs], score, able))
        kinds = {"ours": pa.int64(), "theirs": pa.int64(), "score": pa.float64(), "able": pa.bool_()}
        return pa.concat_tables(pa.table({n: pa.array(x, kind) for (n, kind), x in zip(kinds.items(), some, strict=True)}) for some in columns)

    return run


def compared(new: DataFrame, known: DataFrame, share: float = SHARE, most: int | None = MOST, least: float = LEAST) -> DataFrame:
    """(ours, theirs, score, able) of numbered classes that share enough words: of each cell the best `most` of a new title, and whether their lengths allow a ratio of `least`."""
    words = F.array_distinct(F.split("name", " ", -1))
    chars = F.coalesce(F.sum(F.length("name") + 1), F.lit(0))
    classes, usual, held = known.agg(F.count(F.lit(1)), F.avg(F.size(F.split("name", " ", -1))), chars).first()
    blocks = max(1, -(-held // BLOCK))
    parts = max(-(-new.agg(chars).first()[0] // PART), -(-CELLS // blocks))
    df = known.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).cast("int").alias("df"))
    each = new.select(F.col("number").alias("ours"), F.posexplode(words).alias("at", "w")).join(df, "w", "left").na.fill(0, ["df"])
    asked = each.groupBy("ours").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda e: e["df"]).alias("dfs"))  # a title's words
    asked = asked.where(F.size(F.filter("dfs", lambda n: n > 0)) >= F.greatest(F.lit(1), F.floor(F.size("dfs") * F.lit(share) + 1e-9)))
    asked = asked.join(new.select(F.col("number").alias("ours"), "name"), "ours").withColumn("part", F.pmod(F.xxhash64("ours"), F.lit(parts)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("part", "block", "ours", "name", "dfs")
    held = known.select(F.col("number").alias("theirs"), "name").withColumn("block", F.pmod(F.xxhash64("theirs"), F.lit(blocks)).cast("int"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("part", "block", "theirs", "name")
    asked, held = (side.repartition(2 * blocks * parts, "part", "block") for side in (asked, held))  # small cells are long work, so none are put together by their bytes
    cells = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block"))
    return cells.applyInArrow(_compared(share, most, least, classes, usual), "ours long, theirs long, score double, able boolean")


def candidates(new: DataFrame, known: DataFrame, share: float = SHARE) -> DataFrame:
    """(ours, theirs, score) of numbered classes: all known names that share enough words with new ones, and how well."""
    return compared(new, known, share, None).select("ours", "theirs", "score")


def _firsts(least: float):
    """Of pairs (ours, theirs, name, other) in the order of each of ours the first with the ratio; none after it is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for ours, theirs, name, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ours != last and (ratio := ratio_at_least(name, other, least)) is not None:
                    last = ours
                    out.append((ours, theirs, ratio))
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate({"ours": pa.int64(), "theirs": pa.int64(), "ratio": pa.float64()}.items())})

    return run


def near_titles(new: DataFrame, known: DataFrame, id_col: str, title_col: str, share: float = SHARE, most: int = MOST, least: float = LEAST) -> DataFrame:
    """new's id with duplicate_of and ratio: the smallest id of the first class, by score, among the `most` best with a ratio of at least `least`.

    Null, empty and wordless titles match nothing; rows of one title get the same answer.
    """
    ours, theirs = _classes(new, id_col, title_col), _classes(known, id_col, title_col)
    order = Window.partitionBy("ours").orderBy(F.col("score").desc(), "theirs")  # at most `most` rows a block
    best = compared(ours, theirs, share, most, least).withColumn("place", F.row_number().over(order)).where((F.col("place") <= most) & F.col("able"))
    pairs = best.join(theirs.select(F.col("number").alias("theirs"), F.col("name").alias("other")), "theirs").join(ours.select(F.col("number").alias("ours"), "name"), "ours")
    pairs = pairs.repartition("ours").sortWithinPartitions("ours", "place").select("ours", "theirs", "name", "other")
    near = pairs.mapInArrow(_firsts(least), "ours long, theirs long, ratio double")
    first = near.join(theirs.select(F.col("number").alias("theirs"), "id"), "theirs").join(ours.select(F.col("number").alias("ours"), "name"), "ours")
    rows = new.select(F.col(id_col), normalised(F.col(title_col)).alias("name"))
    return rows.join(first.select("name", F.struct("id", "ratio").alias("found")), "name", "left").select(id_col, F.col("found.id").alias("duplicate_of"), F.col("found.ratio").alias("ratio"))
