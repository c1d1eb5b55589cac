"""Quality classifier: a small byte-level convolutional network, trained and applied in numpy.

Input: a text's UTF-8 bytes, each with one flag, whether the four bytes from here on stood up to LAGS bytes before
(so a word said again and again shows). A symbol (byte and flag) has a learned embedding, and FILTERS learned filters
run over WIDTH symbols each. The whole text is covered by overlapping chunks; each filter is max-pooled over each
chunk, and the chunks' values are combined, by their maximum and by their mean, into one logit and so one probability.

Training takes a bounded sample: at most `per_class` labelled documents of each class, chosen by a hash of their ids
outside the held-out fold, and a few random chunks of each. It runs on the driver with a fixed seed. Scoring is a map
over the documents, without a shuffle: embedding and filters are folded into one table for each filter position, so a
byte costs WIDTH table rows.

Defined cases: a null or empty text is scored like any other, as one chunk of padding; without labelled rows of both
classes the score is the share of good labels (0.5 if there is none); repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import slices, small_batches

SYMBOLS, EMBED, WIDTH, FILTERS = 512, 8, 6, 16
CHUNK, STRIDE = 512, 448
LAGS = range(3, 25)
#: Zero bytes between the texts of a slab: wider than the filters and the lags.
GAP = 32
#: Bytes that are scored at once, and chunks of a text in one piece of them.
SLAB, PIECE_CHUNKS = 1 << 18, 512
PER_CLASS, CHUNKS_EACH, EPOCHS, BATCH, RATE = 1200, 5, 14, 32, 0.01
#: The score from which a document counts as good.
THRESHOLD = 0.7


def symbols(data: np.ndarray) -> np.ndarray:
    """Bytes to symbols; data ends in at least four zero bytes."""
    out = data.astype(np.int32)
    n = len(data) - 3
    four = out[:n] | out[1 : n + 1] << 8 | out[2 : n + 2] << 16 | out[3 : n + 3] << 24
    again = np.zeros(n, bool)
    for lag in LAGS:
        again[lag:] |= four[lag:] == four[:-lag]
    again &= data[:n] > 0
    out[:n] |= again.astype(np.int32) << 8
    return out


def chunk_bounds(length: int) -> list[tuple[int, int]]:
    """Overlapping chunks (begin, end) that cover positions 0 to length, one at least."""
    starts = range(0, max(1, length - (CHUNK - STRIDE)), STRIDE)
    return [(a, min(a + CHUNK, max(length, 1))) for a in starts]


@dataclass
class Network:
    embed: np.ndarray  # SYMBOLS x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 FILTERS: of the maxima, of the means
    offset: float

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        return Network(rng.normal(0, 0.5, (SYMBOLS, EMBED)), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)

    def tables(self) -> list[np.ndarray]:
        return [np.ascontiguousarray(self.embed @ self.filters[k], dtype=np.float32) for k in range(WIDTH)]


def convolve(tables: list[np.ndarray], bias: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Filter values at each position but the last WIDTH - 1."""
    n = len(symbol) - WIDTH + 1
    out = tables[0].take(symbol[:n], axis=0)
    for k in range(1, WIDTH):
        out += tables[k].take(symbol[k : n + k], axis=0)
    out += bias.astype(np.float32)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], good: list[int], seed: int = 7) -> Network:
    """Adam on the logistic loss over documents, each seen through random chunks; gradients flow through the maxima."""
    rng = np.random.default_rng(seed)
    net = Network.start(rng)
    label = np.array(good, np.float64)
    share = label.mean()
    balance = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    sources = [symbols(np.frombuffer(t + bytes(GAP), np.uint8)) for t in texts]
    names = ("embed", "filters", "bias", "weights")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names} | {"offset": [0.0, 0.0]}
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            ids = order[at : at + BATCH]
            parts, owner = [], []
            for row, i in enumerate(ids):
                bounds = chunk_bounds(len(texts[i]))
                for c in rng.permutation(len(bounds))[:CHUNKS_EACH]:
                    a, b = bounds[c]
                    parts.append(sources[i][a : b + WIDTH - 1])
                    owner.append(row)
            owner = np.array(owner)
            sizes = np.array([len(p) for p in parts])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            line = np.concatenate(parts)
            value = convolve(net.tables(), net.bias, line)
            top = np.empty((len(parts), FILTERS))
            where = np.empty((len(parts), FILTERS), np.int64)
            for c, (a, n) in enumerate(zip(begin.tolist(), sizes.tolist(), strict=True)):
                block = value[a : a + n - WIDTH + 1]
                where[c] = block.argmax(axis=0) + a
                top[c] = block[where[c] - a, np.arange(FILTERS)]
            act = np.maximum(top, 0)
            counts = np.bincount(owner, minlength=len(ids))[:, None]
            mean = np.zeros((len(ids), FILTERS))
            np.add.at(mean, owner, act)
            mean /= counts
            most = np.full((len(ids), FILTERS), -1.0)
            np.maximum.at(most, owner, act)
            feature = np.concatenate([most, mean], axis=1)
            p = _sigmoid(feature @ net.weights + net.offset)
            error = (p - label[ids]) * balance[ids] / len(ids)
            grad = {"weights": feature.T @ error + 1e-4 * net.weights, "offset": error.sum()}
            back = error[:, None] * net.weights[None, :]
            through = (back[:, FILTERS:] / counts)[owner] + back[owner, :FILTERS] * (act == most[owner])
            through *= top > 0
            grad["bias"] = through.sum(axis=0)
            grad["filters"], grad["embed"] = np.zeros_like(net.filters), np.zeros_like(net.embed)
            for k in range(WIDTH):
                symbol = line[where + k]  # chunks x filters
                vector = net.embed[symbol]  # chunks x filters x EMBED
                grad["filters"][k] = np.einsum("cfe,cf->ef", vector, through)
                np.add.at(grad["embed"], symbol, through[:, :, None] * net.filters[k].T[None])
            step += 1
            for name, g in grad.items():
                m = moments[name]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - change)
    return net


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
    """(text, bytes, chunks): a text in pieces of at most PIECE_CHUNKS chunks, each with the bytes around it that its symbols and filters see."""
    for i, text in enumerate(texts):
        bounds = chunk_bounds(len(text))
        for at in range(0, len(bounds), PIECE_CHUNKS):
            part = bounds[at : at + PIECE_CHUNKS]
            low = max(0, part[0][0] - GAP)
            yield i, text[low : part[-1][1] + WIDTH + 8], [(a - low, b - low) for a, b in part]


def logits(net: Network, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
    """One logit a text, over all its chunks."""
    tables = tables or net.tables()
    most, total, count = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))

    def take(held: list[tuple[int, bytes, list[tuple[int, int]]]]) -> None:
        symbol = symbols(np.frombuffer(bytes(GAP).join(data for _, data, _ in held) + bytes(GAP), np.uint8))
        spans, owner, base = [], [], 0
        for i, data, chunks in held:
            spans += [x for a, b in chunks for x in (base + a, base + b)]
            owner += [i] * len(chunks)
            base += len(data) + GAP
        act = np.maximum(np.maximum.reduceat(convolve(tables, net.bias, symbol), spans, axis=0)[::2], 0).astype(np.float64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        own = np.array(owner)[first]
        most[own] = np.maximum(most[own], np.maximum.reduceat(act, first, axis=0))
        total[own] += np.add.reduceat(act, first, axis=0)
        count[own] += np.diff(np.append(first, len(owner)))

    held, size = [], 0
    for piece in _pieces(texts):
        if held and size + len(piece[1]) > SLAB:
            take(held)
            held, size = [], 0
        held.append(piece)
        size += len(piece[1]) + GAP
    if held:
        take(held)
    return np.concatenate([most, total / np.maximum(count, 1)[:, None]], axis=1) @ net.weights + net.offset


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> list[tuple[str | None, int]]:
    """At most per_class texts of each class outside the held-out fold, by a hash of their ids; of rows that repeat an id, the least text."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).dropDuplicates(["_id"])
    ids = known.where("_label = 0").orderBy(F.xxhash64("_id"), "_id").limit(per_class).unionByName(known.where("_label = 1").orderBy(F.xxhash64("_id"), "_id").limit(per_class))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).join(F.broadcast(ids), "_id")  # at most 2 x per_class ids
    found = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    return [(r._text, r._label) for r in sorted(found, key=lambda r: r._id)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, seed: int = 7) -> Network:
    """Network whose score of THRESHOLD separates the classes of a part of the sample that training didn't see."""
    rows = labelled_sample(docs, labels, "quality", id_col, text_col, per_class)
    texts, good = [(t or "").encode() for t, _ in rows], np.array([y for _, y in rows], np.int64)
    if len(set(good.tolist())) < 2:
        net = Network.start(np.random.default_rng(seed))
        share = float(good.mean()) if len(good) else 0.5
        net.weights[:] = 0
        net.offset = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return net
    aside = np.random.default_rng(seed).permutation(len(texts))[: len(texts) // 5]
    rest = np.setdiff1d(np.arange(len(texts)), aside)
    if len(set(good[rest].tolist())) < 2:
        rest = np.arange(len(texts))
    net = train([texts[i] for i in rest], good[rest].tolist(), seed)
    scored = logits(net, [texts[i] for i in aside])
    net.offset += _shift(scored, good[aside])
    return net


def _shift(scored: np.ndarray, good: np.ndarray) -> float:
    """What to add to logits so that THRESHOLD falls where few good and few bad lie on the wrong side, the good counting thrice."""
    target = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    if len(set(good.tolist())) < 2:
        return 0.0
    bad, fine = np.sort(scored[good == 0]), np.sort(scored[good == 1])
    grid = np.unique(np.concatenate([bad, fine]))
    places = (grid[1:] + grid[:-1]) / 2
    lost = np.searchsorted(fine, places) / len(fine)
    let = 1 - np.searchsorted(bad, places) / len(bad)
    cost = 3 * lost + let
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return target - float(places[best[len(best) // 2]])


def _scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigmoid(logits(net, texts, tables)), pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, net: Network, carried: F.Column, text_col: str = "text") -> DataFrame:
    """(row, score): `carried`, a column of docs, beside the probability that the document is good."""
    source = docs.select(carried.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return small_batches(source).mapInArrow(_scorer(net), T.StructType([source.schema["row"]]).add("score", "double"))
