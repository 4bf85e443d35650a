"""Near-duplicate classes by MinHash with sequential Bayesian verification.

1. One pass makes for every text the number of its distinct shingles, a key of its word sequence,
   and ``BANDS`` keys of ``ROWS`` minima each.  Equal word sequences are one node from here on.
2. Nodes that share a band key are candidates.  Each key links its nodes to the smallest one, a
   star with one edge less than nodes, never all pairs; the components of these edges are
   neighbourhoods: any two candidates are in the same one.
3. The texts of neighbourhoods of two nodes or more are dealt into blocks of bounded size.  Each
   pair of blocks (most neighbourhoods are one block) compares its candidates: signature batches
   one after another, leaving out a pair as soon as the posterior chance that its similarity reaches
   the threshold is below MISS; survivors are counted exactly on their full shingle sets.  A pair
   already linked within the task by way of others needs no check.  What a task returns is a forest.
4. The components of those forests are the classes.

A candidate pair meets all of its band keys with probability 1 - (1 - s**ROWS)**BANDS, which is
0.999997 at the threshold itself.  Nothing is capped: a large neighbourhood becomes more block pairs.

Cases: a null, empty or blank text has no shingle and stands alone; one word is its own shingle;
equal texts are one class; rows with equal ids count as one document with several texts; a null id
is never linked (its class is null) and kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import LOWER, NOT_SPACE, mix, pairs, slices, span_hash, word_bounds
from .shared import bound_batches, checkpointed, shuffle_width, text_or_empty, written

SHINGLE_WORDS = 5
THRESHOLD = 80
BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-5
#: Nodes and shingles of a block at most, and those of small neighbourhoods that share a task.
BLOCK_NODES, BLOCK_SHINGLES = 256, 400_000
TASK_NODES, TASK_SHINGLES = 512, 400_000
#: Tasks of small neighbourhoods for each shuffle partition at least, so that chance evens them out.
TASKS_A_PARTITION = 4

_SEED = np.random.default_rng(20240229)
_FACTORS = _SEED.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_ids(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the shingles of every row's words, one after another, and how many each row has (with repeats)."""
    n = np.diff(first)
    if not len(words):
        return words, n
    ids = words
    for k in range(1, size):
        ids = pairs_with(ids, words, k)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - first[:-1][row]
    full = place + size <= n[row]
    short = (n[row] < size) & (place == 0)
    out = np.where(full, ids, 0)
    for r in np.unique(row[short]).tolist():  # fewer words than a shingle: the whole sequence
        whole = words[first[r] : first[r + 1]]
        value = whole[:1]
        for w in whole[1:]:
            value = pairs(np.array([value[0], w], np.uint64))
        out[first[r]] = mix(value + np.uint64(len(whole)))[0]
    keep = full | short
    return out[keep], np.bincount(row[keep], minlength=len(n))


def pairs_with(left: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Extend ids that begin at each word by the word ``k`` places on (the tail is of no use)."""
    out = left.copy()
    if len(words) > k:
        out[:-k] = mix(left[:-k] * np.uint64(0xD6E8FEB86659FD93) + words[k:])
    return out


def row_shingles(buf: np.ndarray, off: np.ndarray, size: int):
    low = LOWER[buf]
    starts, ends, first = word_bounds(low, off, NOT_SPACE)
    words = span_hash(low, starts, ends)
    ids, counts = shingle_ids(words, first, size)
    return words, first, ids, counts


def minima(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The signature of every row that has shingles: rows by BANDS * ROWS."""
    begin = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(begin), len(_FACTORS)), np.uint32)
    if len(begin):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat((ids * factor >> np.uint64(32)).astype(np.uint32), begin)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    cells = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return keys


def distinct_counts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    out = np.zeros(len(counts), np.int64)
    for r, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
        if b > a:
            v = np.sort(ids[a:b])
            out[r] = 1 + np.count_nonzero(v[1:] != v[:-1])
    return out


def summaries(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, content, bands) of every document."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                words, first, ids, counts = row_shingles(buf, off, size)
                keys = band_keys(minima(ids, counts)).view(np.int64)
                width = np.where(counts > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(keys.ravel()))
                content = [hashlib.blake2b(words[x:y].tobytes(), digest_size=16).digest() for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(distinct_counts(ids, counts)), pa.array(content, pa.binary()), bands], names=["id", "n", "content", "bands"])

    return kept.mapInArrow(run, "id long, n long, content binary, bands array<long>")


def least_agreements(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared minima: the agreements below which a pair is left out.

    With a uniform prior, the chance of a similarity of at least t after m agreements in n is that
    of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


class Block:
    """Nodes of one task with their sets and signatures."""

    def __init__(self, ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], sig: np.ndarray):
        self.ids, self.side, self.sets, self.sig = ids, side, sets, sig
        self.size = np.array([len(s) for s in sets])
        self.bands = band_keys(sig)

    def forest(self, threshold: int) -> list[tuple[int, int]]:
        """Links that join all candidates at the threshold: pairs of different sides, or any if all are on one."""
        least = least_agreements(threshold / 100)
        root = np.arange(len(self.ids))
        both = len(np.unique(self.side)) > 1
        out = []
        for x in range(len(self.ids) - 1):
            ys = np.arange(x + 1, len(self.ids))
            ys = ys[root[ys] != root[x]]
            if both:
                ys = ys[self.side[ys] != self.side[x]]
            small, large = np.minimum(self.size[x], self.size[ys]), np.maximum(self.size[x], self.size[ys])
            ys = ys[100 * small >= threshold * large]
            ys = ys[(self.bands[ys] == self.bands[x]).any(1)]
            agree = np.zeros(len(ys), np.int64)
            for k, m in enumerate(least):
                if not len(ys):
                    break
                part = slice(k * BATCH, (k + 1) * BATCH)
                agree += (self.sig[ys, part] == self.sig[x, part]).sum(1)
                ys, agree = ys[agree >= m], agree[agree >= m]
            if not len(ys):
                continue
            shared = self._common(x, ys)
            for y in ys[100 * shared >= threshold * (self.size[x] + self.size[ys] - shared)].tolist():
                if root[y] != root[x]:
                    out.append((int(self.ids[x]), int(self.ids[y])))
                    root[root == root[y]] = root[x]
        return out

    def _common(self, x: int, ys: np.ndarray) -> np.ndarray:
        own = self.sets[x]
        other = np.concatenate([self.sets[y] for y in ys])
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        begin = np.cumsum(self.size[ys]) - self.size[ys]
        return np.add.reduceat((own[at] == other).astype(np.int64), begin)


def verify(table: pa.Table, size: int, threshold: int) -> pa.Table:
    """The forests of all block pairs in a task's rows (grp, i, j, side, id, text)."""
    table = table.sort_by([(c, "ascending") for c in ("grp", "i", "j", "side", "id")])
    sets, sigs, full = [], [], []
    for _, _, buf, off in slices(table["text"]):
        _, _, ids, counts = row_shingles(buf, off, size)
        sigs.append(minima(ids, counts))
        ends = np.cumsum(counts)
        sets += [np.unique(ids[a:b]) for a, b in zip(ends - counts, ends) if b > a]
        full.append(counts > 0)
    sig, full = np.concatenate(sigs), np.concatenate(full)
    # an id of several texts may also have one without shingles
    key = np.stack([table[c].to_numpy()[full] for c in ("grp", "i", "j")])
    ids, side = table["id"].to_numpy()[full], table["side"].to_numpy()[full]
    cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True])
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        out += Block(ids[a:b], side[a:b], sets[a:b], sig[a:b]).forest(threshold)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def neighbourhoods(nodes: DataFrame) -> DataFrame:
    """(node, grp) of nodes that share a band key with another; ``nodes`` has (node, bands)."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    stars = keys.join(heads, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    return components(stars).select("node", F.col("root").alias("grp"))


def block_rows(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(task, grp, i, j, side, id, text): the texts that each task compares; ``members`` has (node, grp, n)."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("all"))
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(sizes.select("grp", blocks.alias("blocks")), "grp")
    placed = checkpointed(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    total = placed.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nodes")).first()
    least = TASKS_A_PARTITION * shuffle_width(docs.sparkSession)
    tasks = int(max(least, total["nodes"] // TASK_NODES, (total["n"] or 0) // TASK_SHINGLES))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    each = texts.join(placed, F.col("id") == F.col("node")).withColumn("other", other)
    each = each.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "id", "text", "blocks")
    alone = F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("long")
    return each.withColumn("task", F.when(F.col("blocks") == 1, alone).otherwise(F.xxhash64("grp", "i", "j"))).drop("blocks")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document; links are similarities of at least ``threshold`` percent."""
    bound_batches(docs.sparkSession)
    rows = written(summaries(docs, id_col, text_col, shingle_words), "summaries")
    full = rows.where("n > 0 and id is not null")
    nodes = full.groupBy("content").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    near = neighbourhoods(nodes)
    # a document may stand for several word sequences if its id is repeated
    sizes = full.groupBy("id").agg(F.sum("n").alias("n"))
    members = near.join(sizes, near["node"] == sizes["id"]).select("node", "grp", "n")

    def run(table: pa.Table) -> pa.Table:
        return verify(table, shingle_words, threshold)

    links = block_rows(members, docs, id_col, text_col).groupBy("task").applyInArrow(run, "a long, b long")
    classes = components(links)
    firsts = full.groupBy("content").agg(F.min("id").alias("node"))
    named = firsts.join(classes, "node", "left").select("content", F.coalesce("root", "node").alias("component_id"))
    every = rows.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("content")).alias("content"))
    out = every.join(named, "content", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class only, that of the smallest id (a null id last).

    Rows are told apart by a key of their own, as ids may be null or repeated, and carried whole in
    one column, so their names cannot clash with any of ours.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "rows")
    own = keyed.select("key", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"))
    classes = near_duplicates(own, "key", "text", **options).select(F.col("key").alias("of"), "component_id")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = classes.join(own.select("key", "id"), F.col("of") == F.col("key")).groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(first.select(F.col("first.key").alias("key")), "key", "left_semi").select("row.*")
