"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 6 bytes, with marks at
both ends) and of the word itself, all hashed into one table; so a misspelt or inflected word lands
near the words it shares n-grams with.  A passage's vector is the mean over its words, and a linear
softmax tells the two classes apart.  A text is as toxic as its worst passage of PASSAGE words, so
a few words are not diluted in a long text: every passage of the whole text is scored.

As both layers are linear, once trained an n-gram needs only one number, its vector times the
difference of the two class vectors; a word's number is worked out once in each slice.

Training runs over a bounded sample (``per_class`` rows of either label at most) in one task, with
row-wise adaptive rates; each step moves the n-grams and class vectors of the passage that is
worst at the moment.

Cases: a null or empty text has no word and gets the score of the bias; without any label scores
are 0.5; a text shorter than a passage is one passage; rows are independent, so repeats, ties and
hot keys need no care; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import ALNUM, LOWER, mix, slices, span_hash, word_bounds
from .training import fit, scored, sigmoid, training_rows

BUCKETS_BITS = 18
GRAMS = (3, 4, 5, 6)
DIM = 8
PASSAGE = 8
PER_CLASS = 3000
EPOCHS = 6
#: Small samples get more rounds: at least so many steps in all.
LEAST_STEPS = 12000
LEAST_TEXTS = 3
RATE = 0.5
THRESHOLD = 0.5
_MULT = np.array([pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k in range(1, 8)], np.uint64)


def word_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of given words one after another, and how many each word has."""
    size = ends - starts + 2
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.full(begin[-1], ord("<"), np.uint8)
    inner = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    middle = (inner > 0) & (inner < np.repeat(size, size) - 1)
    text[middle] = buf[(inner - 1 + np.repeat(starts, size))[middle]]
    text[begin[1:] - 1] = ord(">")
    word = np.repeat(np.arange(len(starts)), size)
    left = np.repeat(size, size) - inner
    owner, bucket = [np.arange(len(starts))], [ids]
    wide = text.astype(np.uint64) + np.uint64(1)
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += wide[at + k] * _MULT[k]
        owner.append(word[at])
        bucket.append(mix(h))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    return (bucket[order] >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64), np.bincount(owner, minlength=len(starts))


def distinct_words(buf: np.ndarray, offsets: np.ndarray):
    """For a slice: row bounds, each word's number among the distinct ones, and their n-grams."""
    low = LOWER[buf]
    starts, ends, first = word_bounds(low, offsets, ALNUM)
    h = span_hash(low, starts, ends)
    ids, at, number = np.unique(h, return_index=True, return_inverse=True)
    grams, counts = word_grams(low, starts[at], ends[at], ids)
    return first, number, grams, counts


def worst_passages(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest mean of PASSAGE neighbouring values in each row, and where it begins (-1: no value)."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    best, where = np.zeros(len(first) - 1), np.full(len(first) - 1, -1)
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if a == b:
            continue
        w = min(PASSAGE, b - a)
        means = total[a + w : b + 1] - total[a : b + 1 - w]
        i = int(means.argmax())
        best[k], where[k] = means[i] / w, a + i
    return best, where


def _sample(table: pa.Table) -> list[tuple]:
    """For each text: its words in order as numbers of its distinct ones, their n-grams, sizes and the label.

    N-grams of fewer than LEAST_TEXTS texts could only be learned by heart, so they get no bucket.
    """
    y = table["y"].to_numpy()
    rows, texts = [], np.zeros(1 << BUCKETS_BITS, np.int32)
    for a, b, buf, off in slices(table["text"]):
        first, number, grams, counts = distinct_words(buf, off)
        begin = np.concatenate([[0], np.cumsum(counts)])
        for k in range(b - a):
            own, seq = np.unique(number[first[k] : first[k + 1]], return_inverse=True)
            sizes = counts[own]
            flat = grams[_ranges(begin[own], sizes)].astype(np.int32)
            texts[np.unique(flat)] += 1
            rows.append((seq, flat, sizes, int(y[a + k])))
    common = texts >= LEAST_TEXTS
    return [(seq, np.where(common[flat], flat, 1 << BUCKETS_BITS), sizes, y) for seq, flat, sizes, y in rows]


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for ``sizes[0]`` numbers, then the same for the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def learn(table: pa.Table) -> dict[str, np.ndarray]:
    rows = _sample(table)
    rng = np.random.default_rng(11)
    vectors, out = rng.normal(0, 0.1, ((1 << BUCKETS_BITS) + 1, DIM)), rng.normal(0, 0.5, (2, DIM))
    vectors[-1] = 0  # the slot of n-grams without a bucket
    bias, seen, seen_out, seen_bias = np.zeros(2), np.zeros((1 << BUCKETS_BITS) + 1), 1e-3, 1e-3
    share = np.bincount([r[3] for r in rows], minlength=2)
    weight = share.sum() / np.maximum(1, 2 * share)
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(rows))))
    for epoch in range(epochs):
        for k in rng.permutation(len(rows)):
            seq, flat, sizes, target = rows[k]
            if not len(seq):
                continue
            begin = np.cumsum(sizes) - sizes
            number = np.add.reduceat(vectors[flat] @ (out[1] - out[0]), begin) / sizes
            if epoch < epochs // 3:
                passage = seq  # whole texts first: what is common to a class shows before passages are chosen
            else:
                at = worst_passages(number[seq], np.array([0, len(seq)]))[1][0]
                passage = seq[at : at + PASSAGE]
            words, n = np.unique(passage, return_counts=True)
            bag = flat[_ranges(begin[words], sizes[words])]
            part = np.repeat(n / (len(passage) * sizes[words]), sizes[words])
            x = part @ vectors[bag]
            logit = out @ x + bias
            p = np.exp(logit - logit.max())
            d = (p / p.sum() - np.array([1 - target, target])) * weight[target]
            move, grad_out = d @ out, d[:, None] * x
            np.add.at(seen, bag, part**2 * (move @ move) / DIM)
            step = RATE * part / np.sqrt(seen[bag] + 1e-10)
            step[bag == 1 << BUCKETS_BITS] = 0
            for q in range(DIM):
                np.add.at(vectors[:, q], bag, -step * move[q])
            seen_out += (grad_out**2).mean()
            out -= 0.05 * grad_out / np.sqrt(seen_out)
            seen_bias += (d * d).mean()
            bias -= 0.1 * d / np.sqrt(seen_bias)
    number = (vectors @ (out[1] - out[0])).astype(np.float32)[:-1]
    number[seen[:-1] == 0] = 0.0
    used = np.flatnonzero(number)
    return {"at": used, "number": number[used], "bias": np.array([bias[1] - bias[0]])}


def scorer(model: dict[str, np.ndarray]):
    at, number_of, bias = model["at"], model["number"], float(model["bias"][0])

    def score(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BUCKETS_BITS, np.float32)
        table[at] = number_of
        first, number, grams, counts = distinct_words(buf, offsets)
        if not len(number):
            return np.full(len(offsets) - 1, sigmoid(bias))
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        words = np.add.reduceat(table[grams].astype(np.float64), begin) / counts
        return sigmoid(bias + worst_passages(words[number], first)[0])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = fit(training_rows(docs, labels, label, per_class, id_col, text_col), learn)
    return scored(docs, scorer(model), threshold, id_col, text_col)
