"""Document fingerprints: digests of improbable features, compared by normalised bit overlap.

Every window of 64 bytes has an entropy; windows whose (rounded) entropy is rare in the corpus are
improbable.  Within each run of 64 neighbouring windows the rarest one (the first of equals) earns a
point, and windows with enough points are the text's features: they are found again in any text that
shares the passage.  Each feature sets five bits of a Bloom filter of 2048 bits; a filter takes 160
features, then the next one of the chain begins.

Entropies come from two counts at each byte, how often it recurs in the 63 bytes after it and
before it: they say how the sum of c*log(c) over the window changes when it moves by one.  The sums
are integers, so equal windows have equal entropies wherever they stand.

Two digests are alike by the mean, over the filters of the shorter chain, of the best overlap with a
filter of the other: bits in common beyond what chance gives, over the most there could be.

Cases: a null text is empty; an empty text has no feature and the digest "", which is like another
empty one (1.0) and unlike all others (0.0); a text shorter than a window has itself as its feature;
equal texts have equal digests, and texts of any length are read whole; repeated ids are ordered by
text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SLICE_BYTES, mix, slices, span_hash
from .shared import shuffle_width, text_or_empty

WINDOW = 64
#: Points, of the 64 that a window can earn, from which it is a feature.
POINTS = 16
BITS, PER_FILTER, HASHES = 2048, 160, 5
#: Bytes of text in a bucket of neighbours, about.
BUCKET_BYTES = 64 << 20
#: Entropies are rounded to 1/LEVELS of the largest.
LEVELS = 1000
_SCALE = 1 << 16
#: Of the overlap beyond chance, what filters of unrelated texts may still share.
CHANCE_MARGIN = 0.1


def _log_table() -> np.ndarray:
    c = np.arange(WINDOW + 2, dtype=np.float64)
    c[0] = 1
    return np.round(c * np.log2(c) * _SCALE).astype(np.int64)


def entropy_levels(buf: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The entropy level, 0 to LEVELS, of every window of ``buf``."""
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    g = _log_table()
    after, before = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for a in range(0, n, block):  # blocks stay in the processor's cache
        b = min(n, a + block)
        for d in range(1, WINDOW):
            e = min(b, n - d)
            if e > a:
                same = buf[a:e] == buf[a + d : e + d]
                after[a:e] += same
                before[a + d : e + d] += same
    lose = g[np.arange(WINDOW + 1) - 1] - g[: WINDOW + 1]
    gain = g[: WINDOW + 1] - g[np.arange(WINDOW + 1) - 1]
    lose[0] = gain[0] = 0
    total = np.empty(n - WINDOW + 1, np.int64)
    # the first window grows byte by byte: counts before it are cut off at its start
    head = np.bincount(buf[:WINDOW], minlength=256)
    total[0] = g[head].sum()
    total[1:] = lose[after[: n - WINDOW]] + gain[before[WINDOW:]]
    np.cumsum(total, out=total)
    full = g[WINDOW]
    return ((full - total) * LEVELS + full // 2) // full


def inner_windows(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of the first ``n`` windows of a slice lie within one row."""
    step = np.zeros(n + 1, np.int64)
    cut = offsets[1:-1]
    np.add.at(step, np.clip(cut - WINDOW + 1, 0, n), 1)
    np.add.at(step, np.minimum(cut, n), -1)
    return np.cumsum(step[:-1]) == 0


def row_levels(levels: np.ndarray, a: int, b: int) -> np.ndarray:
    """The levels of the row that has bytes ``[a, b)`` of a slice."""
    return levels[a : max(a, b - WINDOW + 1)]


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of the whole corpus have each level: LEVELS + 1 numbers at any input size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for _, _, buf, off in slices(batch.column(0)):
                levels = entropy_levels(buf)
                total += np.bincount(levels[inner_windows(off, len(levels))], minlength=LEVELS + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["level", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "level long, n long")
    out = np.zeros(LEVELS + 1, np.int64)
    for r in counted.groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of every level, 0 for the rarest; equals by the higher entropy."""
    order = np.lexsort((-np.arange(len(counts)), counts))
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    return out


def feature_places(levels: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the windows that are features."""
    n = len(levels)
    if not n:
        return np.zeros(0, np.int64)
    key = (rank[levels] << 40) + np.arange(n)
    width, reach = 1, min(WINDOW, n)
    while width < reach:  # minima over runs that double until they reach the wanted length
        step = min(width, reach - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    points = np.bincount(key & ((1 << 40) - 1), minlength=n)
    return np.flatnonzero(points >= min(POINTS, points.max()))


def digest_of(hashes: np.ndarray) -> np.ndarray:
    """The chain of filters (rows of bytes) of feature hashes in order; repeats are taken once."""
    if not len(hashes):
        return np.zeros((0, BITS // 8), np.uint8)
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    filters = -(-len(h) // PER_FILTER)
    bits = np.zeros((filters, BITS), np.uint8)
    row = np.arange(len(h)) // PER_FILTER
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
    return np.packbits(bits, axis=1)


class Text:
    """The bytes of a text with its entropy levels and feature hashes."""

    def __init__(self, raw: bytes, rank: np.ndarray, levels: np.ndarray | None = None):
        self.raw = raw
        buf = np.frombuffer(raw, np.uint8)
        self.levels = entropy_levels(buf) if levels is None else levels
        if len(buf) >= WINDOW:
            at = feature_places(self.levels, rank)
            hashes = np.concatenate([mix(span_hash_of(buf, at[a : a + 1024])) for a in range(0, len(at), 1024)])
        else:
            hashes = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64) if raw else np.zeros(0, np.uint64)
        self.filters = digest_of(hashes)

    @property
    def fingerprint(self) -> str:
        return base64.b64encode(self.filters.tobytes()).decode()


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], np.uint64)


def span_hash_of(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows at the given places."""
    windows = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[at]
    return ((windows.astype(np.uint64) + np.uint64(1)) * _FACTORS).sum(axis=1, dtype=np.uint64)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1 for two chains of filters; 1 for equal ones."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y = y, x
    a, b = x.view(np.uint64), y.view(np.uint64)
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best = np.empty(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(1)
        most = np.minimum(na[i], nb)
        chance = na[i] * nb / BITS
        floor = np.minimum(chance + CHANCE_MARGIN * np.maximum(most - chance, 0), most - 1e-9)
        best[i] = np.clip((common - floor) / (most - floor), 0, 1).max()
    return float(best.mean())


def edited(text: str, other: str) -> tuple[str, int, int]:
    """``text`` with its last half replaced by the beginning of ``other``; code points kept, and taken."""
    k = len(text) // 2
    kept = len(text) - k
    taken = other[:k]
    return text[:kept] + taken, kept, len(taken)


def edited_text(own: Text, other: Text, rank: np.ndarray) -> Text:
    """The digest of the edited text; only windows across the seam get their entropy anew."""
    text, nxt = own.raw.decode(), other.raw.decode()
    whole, kept, taken = edited(text, nxt)
    raw = whole.encode()
    a, b = len(text[:kept].encode()), len(nxt[:taken].encode())
    if a < WINDOW or b < WINDOW:
        return Text(raw, rank)
    seam = entropy_levels(np.frombuffer(raw[a - WINDOW + 1 : a + WINDOW - 1], np.uint8))
    return Text(raw, rank, np.concatenate([own.levels[: a - WINDOW + 1], seam, other.levels[: b - WINDOW + 1]]))


def fingerprints(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint): the digest of every text."""
    kept = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("__text"))
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                levels = entropy_levels(buf)
                texts = [Text(buf[x:y].tobytes(), rank, row_levels(levels, x, y)) for x, y in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(t.raw.decode()) for t in texts], pa.int64()), pa.array([t.fingerprint for t in texts], pa.string())],
                    names=[id_col, "n_chars", "fingerprint"],
                )

    return kept.mapInArrow(run, schema)


EDITS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(b, extra, i, t): buckets of ids, one a partition, each with the first rows of the bucket after it.

    Documents stand by descending id (nulls last, equals by text), the first one follows the last.
    Bucket bounds are quantiles of the ids, as many as the bytes of the corpus need; within a bucket
    the next row is the next document, and the last row finds its next among the ``extra`` ones.
    Bounds and first ids, two numbers a bucket, go to the tasks as arrays.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_col))).alias("n")).first()["n"] or 0
    width = max(2 * shuffle_width(spark), -(-total // bucket_bytes))
    bounds = ids.where(F.col("i").isNotNull()).approxQuantile("i", [k / width for k in range(1, width)], max(0.1 / width, 1e-5))
    # bucket k holds ids from the k-th highest bound (included) to the one before; nulls come after all
    bounds = np.array(sorted({int(x) for x in bounds or []}), np.int64)
    last = len(bounds) + 1

    known = (F.coalesce("i", F.lit(0)), F.col("i").isNull())  # a column with nulls would arrive as floats

    def bucket_of(i: pd.Series, none: pd.Series) -> np.ndarray:
        return np.where(none, last, len(bounds) - np.searchsorted(bounds, i.to_numpy(np.int64), "right")).astype(np.int32)

    @F.pandas_udf("int")
    def bucket(i: pd.Series, none: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(i, none))

    heads = ids.groupBy(bucket(*known).alias("b")).agg(F.max("i").alias("i")).collect()  # one row a bucket
    heads = {r["b"]: r["i"] for r in heads}
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the bucket that needs b's head: around the circle

    @F.pandas_udf("struct<b:int,to:int>")
    def place(i: pd.Series, none: pd.Series) -> pd.DataFrame:
        b = bucket_of(i, none)
        to = [before[k] if heads[k] == (None if n else x) else None for k, x, n in zip(b.tolist(), i.tolist(), none.tolist())]
        return pd.DataFrame({"b": b, "to": pd.array(to, "Int32")})

    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).withColumn("at", place(*known))
    copies = F.array_compact(F.array(F.struct(F.col("at.b").alias("b"), F.lit(0).alias("extra")), F.when(F.col("at.to").isNotNull(), F.struct(F.col("at.to").alias("b"), F.lit(1).alias("extra")))))
    each = rows.select("i", "t", F.explode(copies).alias("c")).select("c.b", "c.extra", "i", "t")
    return each.repartitionById(last + 1, "b").sortWithinPartitions("extra", F.col("i").desc_nulls_last(), F.col("t").desc())


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: np.ndarray | None = None) -> DataFrame:
    """Every document's digest, that of its edited text, and how like both that and the next document are."""
    if rank is None:
        rank = rarity(level_counts(docs, text_col))
    schema = f"`{id_col}` long, {EDITS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        bucket, last, waiting = None, None, False

        def row(i, own: Text, other: Text) -> tuple:
            new = edited_text(own, other, rank)
            return (
                i, len(own.raw.decode()), hashlib.sha256(new.raw).hexdigest(), own.fingerprint, new.fingerprint,
                likeness(own.filters, new.filters), likeness(own.filters, other.filters),
            )

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(3)]
            for a, b, buf, off in slices(batch.column(3)):
                levels = entropy_levels(buf)
                for k in range(a, b):
                    now = (cols[0][k], cols[1][k])
                    if now[1] and not (waiting and now[0] == bucket):
                        continue  # a further row with the head's id
                    x, y = off[k - a], off[k - a + 1]
                    text = Text(buf[x:y].tobytes(), rank, row_levels(levels, x, y))
                    if waiting:
                        out.append(row(*last, text))
                        size += len(out[-1][3]) + len(out[-1][4])
                    bucket, last, waiting = now[0], (cols[2][k], text), not now[1]
                if size > SLICE_BYTES or len(out) > 2000:
                    yield _edit_batch(out, id_col)
                    out, size = [], 0
        yield _edit_batch(out, id_col)

    return neighbours(docs, id_col, text_col).mapInArrow(run, schema)


def _edit_batch(rows: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [id_col, *(x.split()[0] for x in EDITS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
