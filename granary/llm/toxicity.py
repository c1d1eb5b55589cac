"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

A document's words (runs of letters and digits, lower case) are hashed into DIMS features of 1 + log(count). One
weight vector w serves all grades: P(grade > k) = sigmoid(w x - theta_k) for ordered thresholds theta_0 < theta_1 < ...,
and the expected severity is the sum of these probabilities. The weights are at least zero (a word is
evidence of toxicity or of nothing) and kept sparse by a soft threshold, so long documents don't gather noise; those left are fitted again without it.

The labels say toxic or not, so the ordinal target is made: grades 1 to GRADES are the thirds of the toxic documents by how
many of their words are marked, that is far commoner (by document frequency, smoothed) in toxic than in other documents.
The words are marked by the other half of the sample, so that no document's words decide its own grade.

Training takes a bounded sample (`per_class` labelled documents of each class, outside the held-out fold) on the
driver with fixed steps. Scoring is a map without a shuffle: only words whose feature has a weight count.

The classes are weighed alike, which moves the thresholds down where few words are known; so at last they are moved up together,
if need be, until the first is NO_SIGN, above the score of a document without any weighted word.

Defined cases: a null or wordless text has no features and is scored by the thresholds alone, which say grade 0; without
labelled rows of both classes, or where no word tells them apart, all weights are zero and every document has grade 0;
repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.byte_cnn import labelled_sample
from granary.llm.common import small_batches

DIMS, GRADES = 1 << 18, 3
PER_CLASS, STEPS, RATE, SPARSE = 3000, 300, 0.3, 1e-2
#: A feature is used, and a word marked, if enough toxic documents have it and its smoothed document frequency in them is so many times that in others.
USED, MARKED = 4.0, 8.0
#: Enough is LEAST_SHARE of the toxic documents at hand, between LEAST_DOCS and LEAST.
LEAST_SHARE, LEAST_DOCS, LEAST = 0.1, 2, 5
#: The first threshold is at least this, so that a document without a weighted word is not marked.
NO_SIGN = 1.0
#: How much the losses of the thresholds count: that between clean and toxic most.
FIRST = np.array([8.0, 1.0, 1.0])
_WORD = re.compile(r"\w+")


def features(text: str | None) -> Counter[int]:
    words = Counter(_WORD.findall((text or "").lower()))
    out: Counter[int] = Counter()
    for word, n in words.items():
        out[zlib.crc32(word.encode()) % DIMS] += n
    return out


@dataclass(frozen=True)
class Severity:
    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def expected(self, text: str | None) -> tuple[float, int]:
        """Expected severity, and the grade: how many thresholds are more likely passed than not."""
        known = self.weights
        counts: dict[int, int] = {}
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            i = zlib.crc32(word.encode()) % DIMS
            if i in known:
                counts[i] = counts.get(i, 0) + n
        at = sum(known[i] * float(1 + np.log(counts[i])) for i in sorted(counts))
        passed = [1 / (1 + float(np.exp(min(50.0, max(-50.0, t - at))))) for t in self.thresholds]
        return sum(passed), sum(p >= 0.5 for p in passed)


def contrast(rows: list[Counter[int]], toxic: np.ndarray) -> dict[int, float]:
    """Of each feature that enough toxic documents have, how much commoner it is in toxic documents than in others."""
    seen = [Counter(), Counter()]
    for row, y in zip(rows, toxic.tolist(), strict=True):
        seen[y].update(row.keys())
    n = np.bincount(toxic, minlength=2)
    least = max(LEAST_DOCS, min(LEAST, int(np.ceil(LEAST_SHARE * n[1]))))
    return {i: (c + 0.5) / (n[1] + 1) / ((seen[0][i] + 0.5) / (n[0] + 1)) for i, c in seen[1].items() if c >= least}


def grades(rows: list[Counter[int]], toxic: np.ndarray) -> np.ndarray:
    """0 for others; toxic documents by thirds of their words that the other half of the sample marks."""
    half = np.zeros(len(rows), int)
    for y in (0, 1):  # both halves get as many of each class
        half[np.flatnonzero(toxic == y)[1::2]] = 1
    ratios = [contrast([r for r, h in zip(rows, half, strict=True) if h != own], toxic[half != own]) for own in (0, 1)]
    hits = np.array([sum(v for i, v in row.items() if ratios[h].get(i, 0) > MARKED) for row, h in zip(rows, half.tolist(), strict=True)])
    cuts = np.quantile(hits[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    return np.where(toxic == 1, 1 + (hits[:, None] > cuts[None]).sum(axis=1), 0)


def train(texts: list[str | None], toxic: list[int]) -> Severity:
    """Proximal gradient steps on the mean log loss of the GRADES cumulative links, the classes weighed alike."""
    y = np.array(toxic, np.int64)
    none = Severity({}, tuple(4.0 + k for k in range(GRADES)))
    if len(set(toxic)) < 2:
        return none
    rows = [features(t) for t in texts]
    ratio = contrast(rows, y)
    over = grades(rows, y)[:, None] > np.arange(GRADES)[None]  # documents x thresholds
    rows = [Counter({i: v for i, v in r.items() if ratio.get(i, 0) > USED}) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which, at = np.unique(np.array([i for r in rows for i in r], np.int64), return_inverse=True)
    value = 1 + np.log(np.array([n for r in rows for n in r.values()], np.float64))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))[:, None] / len(y)
    w, theta = np.zeros(len(which)), np.arange(GRADES) + 0.0
    scale, scale_t = np.full(len(which), 1e-8), np.full(GRADES, 1e-8)
    for step in range(2 * STEPS):
        if step == STEPS:  # the weights that are left are fitted again without the threshold's pull to zero
            chosen = w > 0
        score = np.bincount(doc, value * w[at], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))
        error = (p - over) * weight * FIRST
        g = np.bincount(at, value * error.sum(axis=1)[doc], minlength=len(which))
        scale += g * g
        rate = RATE / np.sqrt(scale)
        w -= rate * g
        w = np.maximum(w - rate * SPARSE, 0) if step < STEPS else np.maximum(w, 0) * chosen
        g = -error.sum(axis=0)
        scale_t += g * g
        theta = np.maximum.accumulate(theta - RATE * g / np.sqrt(scale_t))
    if not w.any():
        return none
    theta += max(0.0, NO_SIGN - theta[0])
    return Severity({int(which[i]): float(w[i]) for i in np.flatnonzero(w)}, tuple(theta.tolist()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Severity:
    rows = labelled_sample(docs, labels, "toxic", id_col, text_col, per_class)
    return train([t for t, _ in rows], [y for _, y in rows])


def _grader(model: Severity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.expected(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([g for _, g in found], pa.int32())], ["row", "severity", "grade"])

    return run


def grade(docs: DataFrame, model: Severity, carried: F.Column, text_col: str = "text") -> DataFrame:
    """(row, severity, grade): `carried`, a column of docs, with the expected severity (0 to GRADES) and the grade."""
    source = docs.select(carried.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return small_batches(source).mapInArrow(_grader(model), T.StructType([source.schema["row"]]).add("severity", "double").add("grade", "integer"))
