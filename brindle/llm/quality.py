"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are the longest runs of letters or of other signs; the features of a text are its words and
neighbouring pairs, hashed to ``2**HASH_BITS`` weights.  A pair of equal words is one feature of its
own, whatever the word.  A feature's value is its count over the number of words, times SCALE, so a
score is the mean of weights: a sparse dot product that needs no dictionary.

Training is the proximal update with per-coordinate rates and L1/L2 terms, over a bounded sample
(``per_class`` rows of either label at most) in one task; everything is scored.

Cases: a null or empty text has no feature and gets the score of the bias alone; without any label
all weights are 0 and scores 0.5; texts of any length are read whole; rows are independent, so
repeats, ties and hot keys need no care; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import mix, pairs, row_sums, slices, span_hash, token_bounds
from .training import accepted, fit, scored, sigmoid, training_rows

HASH_BITS = 20
SCALE = 8.0
PER_CLASS = 5000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
THRESHOLD = 0.3
_SAME = np.uint64(0x5EED)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight indices of all words and pairs (pair i is that of words i and i+1), and row bounds.

    The pair that would cross two rows, and the last one, point to the empty slot at the end.
    """
    starts, ends, first = token_bounds(buf, offsets)
    h = span_hash(buf, starts, ends)
    shift = np.uint64(64 - HASH_BITS)
    out = np.full((2, len(h)), 1 << HASH_BITS, np.int64)
    if len(h):
        out[0] = (h >> shift).astype(np.int64)
        two = pairs(h)
        two[h[1:] == h[:-1]] = mix(np.array([_SAME]))[0]
        out[1, :-1] = (two >> shift).astype(np.int64)
        last = first[1:][np.diff(first) > 0] - 1
        out[1, last] = 1 << HASH_BITS
    return out, first


class Leader:
    """Per-coordinate state of the proximal update; the slot after the last weight is the bias."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << HASH_BITS) + 1)
        self.n = np.zeros((1 << HASH_BITS) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (sigmoid(w @ x) - y) * x
        square = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(square) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] = square


def learn(table: pa.Table) -> dict[str, np.ndarray]:
    rows = []
    y = table["y"].to_numpy()
    for a, b, buf, off in slices(table["text"]):
        f, first = features(buf, off)
        for k in range(b - a):
            i, n = np.unique(f[:, first[k] : first[k + 1]], return_counts=True)
            n = n[i < 1 << HASH_BITS]
            i = np.append(i[i < 1 << HASH_BITS], 1 << HASH_BITS)
            rows.append((i, np.append(n * (SCALE / max(1, first[k + 1] - first[k])), 1.0), float(y[a + k])))
    model = Leader()
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k])
    w = model.weights().astype(np.float32)
    used = np.flatnonzero(w)
    return {"at": used, "w": w[used]}


def scorer(model: dict[str, np.ndarray]):
    at, weight = model["at"], model["w"]

    def score(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = np.zeros((1 << HASH_BITS) + 1, np.float32)
        w[at] = weight
        bias = w[-1]
        w[-1] = 0
        f, first = features(buf, offsets)
        return sigmoid(bias + SCALE * row_sums(w[f[0]] + w[f[1]], first) / np.maximum(1, np.diff(first)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(training_rows(docs, labels, label, per_class, id_col, text_col), learn)
    return scored(docs, scorer(model), threshold, id_col, text_col)


def good_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected; the model learns from ``labels`` of ``labelled``."""
    model = fit(training_rows(labelled, labels, label, per_class), learn)
    return accepted(docs, scorer(model), threshold, text_col)
