"""Kernels that pass once over a table and keep the best rows of every query: Arrow batches in, few rows out.

A block of queries is bound to the kernel; what it sees of the table is scored in blocks of at most
CELLS (row, query) pairs, and for each query only the first ``n`` rows of a partition leave it.  So
nothing of the size of rows times queries is shuffled, sorted or spilled.  Scores are rounded as
Spark rounds them before rows are dropped, and equals go by the smaller id, so that the first ``n``
of all partitions together are the first ``n`` of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Scores, and gains that are summed to them, held at once.
CELLS = 2_000_000
#: Bytes of an Arrow batch at most, unless the session says otherwise.
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What stands between rows of one id; no token is written so.
BREAK = "|"
_NULL_ID = np.iinfo(np.int64).min


def over(rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``rows`` through a kernel, in batches bounded by bytes."""
    conf = rows.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(kernel, schema)


def rounded(x: np.ndarray) -> np.ndarray:
    """Rounded half up to six places of the decimal form, as Spark's round does."""
    scaled = x * 1e6
    with np.errstate(invalid="ignore"):
        out = np.rint(scaled) / 1e6 + 0.0
        near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    for i in np.flatnonzero(near):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def id_keys(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, or as objects where they are text."""
    if pa.types.is_integer(ids.type):
        return pc.fill_null(ids.cast(pa.int64()), _NULL_ID).to_numpy(zero_copy_only=False)
    return np.array(ids.to_pylist(), dtype=object)


def id_array(keys: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_integer(kind):
        return pa.array(keys.astype(np.int64), pa.int64(), mask=keys == _NULL_ID).cast(kind)
    return pa.array(list(keys), kind)


class Best:
    """The first ``n`` rows of every query by rounded score, then id."""

    def __init__(self, queries: int, n: int):
        self.n, self.queries = n, queries
        self.floor = np.full(queries, -np.inf)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, first: int = 0, margin: float | np.ndarray = 1e-6, valid: np.ndarray | None = None, exact: Callable | None = None) -> None:
        """Scores (rows, queries) of rows ``ids`` for the queries from ``first`` on; ``valid`` marks the pairs that count, ``exact`` gives the scores of some pairs anew."""
        floor = self.floor[first : first + scores.shape[1]]
        if len(ids) > self.n and np.isneginf(floor).any():
            own = scores if valid is None else np.where(valid, scores, -np.inf)
            floor = np.maximum(floor, np.partition(own, len(ids) - self.n, axis=0)[len(ids) - self.n])
        good = scores >= floor - margin
        if valid is not None:
            good &= valid
        row, query = np.nonzero(good)
        value = scores[row, query] if exact is None else exact(row, query)
        self.rows.append((query + first, ids[row], rounded(value)))
        self.fresh += len(row)
        if self.fresh > max(self.n * self.queries // 4, CELLS // 8):
            self.prune()

    def prune(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((ids, -score, query)) if ids.dtype != object else np.lexsort((np.unique(ids, return_inverse=True)[1], -score, query))
        query, ids, score = query[order], ids[order], score[order]
        starts = np.searchsorted(query, np.arange(self.queries))
        place = np.arange(len(query)) - starts[query]
        last = place == self.n - 1
        self.floor[query[last]] = score[last]
        keep = place < self.n
        self.rows, self.fresh = [(query[keep], ids[keep], score[keep])], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.prune()
        return self.rows[0]


class Asked(NamedTuple):
    """Queries as arrays: ``heads`` (their key columns), the distinct ``words``, and for each word its queries at ``at[start[w] : start[w + 1]]``."""

    heads: pa.Table
    words: pa.Array
    start: np.ndarray
    at: np.ndarray


def asked(table: pa.Table, keys: tuple[str, ...], terms: str = "terms") -> Asked:
    """From (keys, list of terms), one row a query."""
    lists = table.column(terms).combine_chunks()
    query = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(word, kind="stable")
    start = np.searchsorted(word[order], np.arange(len(coded.dictionary) + 1))
    return Asked(table.select(list(keys)).combine_chunks(), coded.dictionary, start, query[order])


def word_ids(column: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a column of texts (tokens joined by blanks) its row and its word's place, -1 for other words."""
    lists = pc.split_pattern(pc.fill_null(column, ""), " ")
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return row, pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def counts(batch: pa.RecordBatch, fields: list[str], words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, frequency in each field) of the words that stand in a batch, ascending."""
    keys = []
    for f in fields:
        row, word = word_ids(batch.column(f), words)
        known = word >= 0
        keys.append(row[known] * len(words) + word[known])
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([0, *map(len, keys)])
    tf = np.stack([np.bincount(inverse[a:b], minlength=len(every)) for a, b in zip(ends, ends[1:])])
    return every // max(1, len(words)), every % max(1, len(words)), tf


def met(asked: Asked, row: np.ndarray, word: np.ndarray, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, cell, posting) for blocks of rows: every (row, query) cell that a posting adds to."""
    queries = len(asked.heads)
    many = (asked.start[1:] - asked.start[:-1])[word]
    upto = np.concatenate([[0], np.cumsum(many)])
    first_of = np.searchsorted(row, np.arange(rows + 1))
    a = 0
    while a < rows:
        room = int(np.searchsorted(upto[first_of], upto[first_of[a]] + CELLS, side="right")) - 1
        b = min(rows, max(a + 1, min(room, a + max(1, CELLS // max(1, queries)))))
        i, j = first_of[a], first_of[b]
        posting = np.repeat(np.arange(i, j), many[i:j])
        within = np.arange(len(posting)) - (upto[posting] - upto[i])
        yield a, b, (row[posting] - a) * queries + asked.at[asked.start[word[posting]] + within], posting
        a = b


def bm25_kernel(asked: Asked, heads: pa.Table, idf: np.ndarray, mean_d: float, weights: list[list[float]], fields: list[str], n: int, k1: float, b: float):
    """Over (doc_id, d, fields): rows of ``heads`` (settings by queries), doc_id and score."""
    queries = len(asked.heads)

    def run(batches):
        best, kind = Best(len(heads), n), None
        for batch in batches:
            kind = batch.column("doc_id").type
            ids, d = id_keys(batch.column("doc_id")), batch.column("d").to_numpy(zero_copy_only=False).astype(float)
            row, word, tf = counts(batch, fields, asked.words)
            gains = []
            for w in weights:
                f = sum((tf[k] * w[k] for k in range(1, len(fields))), tf[0] * w[0])
                gains.append(idf[word] * f * (k1 + 1) / (f + k1 * (1 - b + b * d[row] / mean_d)))
            for lo, hi, cell, posting in met(asked, row, word, batch.num_rows):
                shape = (hi - lo, queries)
                there = (np.bincount(cell, minlength=shape[0] * queries) > 0).reshape(shape)
                for s, gain in enumerate(gains):
                    scores = np.bincount(cell, weights=gain[posting], minlength=shape[0] * queries).reshape(shape)
                    best.add(ids[lo:hi], scores, s * queries, valid=there)
        query, ids, score = best.result()
        if len(query):
            yield from _headed(heads, query, doc_id=id_array(ids, kind), score=pa.array(score))

    return run


def holding_kernel(asked: Asked, need: np.ndarray, fields: list[str]):
    """Over (doc_id, fields): (heads, doc_id) of rows that hold all of a query's (distinct) terms."""
    queries = len(asked.heads)

    def run(batches):
        for batch in batches:
            row, word, _ = counts(batch, fields, asked.words)
            for lo, hi, cell, _ in met(asked, row, word, batch.num_rows):
                at, query = np.nonzero(np.bincount(cell, minlength=(hi - lo) * queries).reshape(hi - lo, queries) == need)
                if len(at):
                    yield from _headed(asked.heads, query, doc_id=batch.column("doc_id").take(pa.array(at + lo)))

    return run


def _headed(heads: pa.Table, query: np.ndarray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    out = heads.take(pa.array(query))
    for name, column in columns.items():
        out = out.append_column(name, column)
    yield from out.to_batches(max_chunksize=100_000)


class Trie(NamedTuple):
    """Grams as a tree: ``root`` (node of each first word), ``steps`` (sorted node * words + word, and the node reached), ``ends`` (gram that ends at a node, else -1)."""

    words: pa.Array
    root: np.ndarray
    steps: np.ndarray
    to: np.ndarray
    ends: np.ndarray
    depth: int


def trie(grams: list[str]) -> Trie:
    split = [g.split(" ") for g in grams]
    place = {w: k for k, w in enumerate(dict.fromkeys(w for g in split for w in g))}
    nodes: dict[tuple[int, int], int] = {}
    ends: list[int] = []
    for k, g in enumerate(split):
        node = -1
        for w in g:
            node = nodes.setdefault((node, place[w]), len(nodes))
            if node == len(ends):
                ends.append(-1)
        ends[node] = k
    root = np.full(max(1, len(place)), -1)
    for (parent, w), node in nodes.items():
        if parent < 0:
            root[w] = node
    steps = sorted((parent * len(place) + w, node) for (parent, w), node in nodes.items() if parent >= 0)
    return Trie(pa.array(list(place), pa.string()), root, np.array([s for s, _ in steps], np.int64), np.array([n for _, n in steps], np.int64), np.array(ends, np.int64), max(map(len, split), default=0))


def gram_kernel(grams: list[str], fields: list[str], most: int | None):
    """Over (doc_id, fields): (gram, doc_id) of rows that hold a gram within one field; of a gram at most ``most`` + 1 rows a partition, which already shows that it is too common."""
    tree, names = trie(grams), pa.array(grams, pa.string())

    def found(batch: pa.RecordBatch) -> np.ndarray:
        hits = []
        for f in fields:
            row, word = word_ids(batch.column(f), tree.words)
            at = np.flatnonzero(word >= 0)
            node = tree.root[word[at]]
            at, node = at[node >= 0], node[node >= 0]
            for k in range(1, tree.depth + 1):
                done = tree.ends[node] >= 0
                hits.append(tree.ends[node[done]] * batch.num_rows + row[at[done]])
                inside = at + k < len(row)
                at, node = at[inside], node[inside]
                on = (row[at + k] == row[at]) & (word[at + k] >= 0)
                at, node = at[on], node[on]
                if not len(at) or not len(tree.steps):
                    break
                step = node * len(tree.words) + word[at + k]
                j = np.minimum(np.searchsorted(tree.steps, step), len(tree.steps) - 1)
                good = tree.steps[j] == step
                at, node = at[good], tree.to[j[good]]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)

    def run(batches):
        seen = np.zeros(len(grams), np.int64)
        for batch in batches:
            hit = found(batch)
            gram, row = hit // max(1, batch.num_rows), hit % max(1, batch.num_rows)
            if most is not None and len(gram):
                place = np.arange(len(gram)) - np.searchsorted(gram, gram) + seen[gram]
                seen += np.bincount(gram, minlength=len(grams))
                gram, row = gram[place <= most], row[place <= most]
            if len(gram):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(gram)), batch.column("doc_id").take(pa.array(row))], ["gram", "doc_id"])

    return run


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dims`` numbers as rows, and which are so; the others are zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    whole = sizes == dims
    if flat.null_count:
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        holes = np.add.reduceat(np.concatenate([flat.is_null().to_numpy(zero_copy_only=False), [False]]).astype(int), np.minimum(starts, len(flat))) if len(lists) else starts
        whole &= ~((holes > 0) & (sizes > 0))
    numbers = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims))
    out[whole] = numbers[np.repeat(whole, np.maximum(sizes, 0))].reshape(int(whole.sum()), dims)
    return out, whole


def dense_kernel(queries: pa.Table, n: int):
    """Over (doc_id, v): (query_id, doc_id, score) of the largest dot products with ``queries`` (query_id, q), a row with itself left out; null scores (no vector, another length) come last.

    A matrix product says which rows can be among the first; their scores are summed anew in the order of the dimensions.
    """
    heads = queries.select(["query_id"]).combine_chunks()
    sizes = pc.list_value_length(queries.column("q").combine_chunks()).to_numpy(zero_copy_only=False)
    groups = []
    for dims in sorted({int(s) for s in np.nan_to_num(sizes.astype(float), nan=0)}):
        q, whole = _matrix(queries.column("q"), dims)
        groups.append((dims, q, whole, np.sqrt((q * q).sum(axis=1))))
    own = id_keys(heads.column("query_id").combine_chunks())

    def run(batches):
        best, kind = Best(len(heads), n), None
        step = max(1, CELLS // max(1, len(heads)))
        for batch in batches:
            kind = batch.column("doc_id").type
            every = id_keys(batch.column("doc_id"))
            made = [(q, some, length, *_matrix(batch.column("v"), dims)) for dims, q, some, length in groups]
            for a in range(0, batch.num_rows, step):
                ids = every[a : a + step]
                scores, largest = np.full((len(ids), len(heads)), -np.inf), np.zeros(len(heads))
                for q, some, length, v, whole in made:
                    v, whole = v[a : a + step], whole[a : a + step]
                    part = v @ q.T
                    pairs = whole[:, None] & some[None, :]
                    scores = np.where(pairs, np.where(np.isnan(part), np.inf, part), scores)
                    largest = np.maximum(largest, np.where(some, length * np.nan_to_num(np.sqrt((v * v).sum(axis=1))).max(initial=0.0), 0.0))

                def exact(row, query):
                    out = scores[row, query]
                    for q, some, _, v, whole in made:
                        pick = np.flatnonzero(whole[a : a + step][row] & some[query])
                        x, y, total = v[a + row[pick]], q[query[pick]], np.zeros(len(pick))
                        for j in range(q.shape[1]):
                            total = total + x[:, j] * y[:, j]
                        out[pick] = np.where(np.isnan(total), np.inf, total)
                    return out

                best.add(ids, scores, margin=2e-6 + 1e-12 * np.nan_to_num(largest), valid=ids[:, None] != own[None, :], exact=exact)
        query, ids, score = best.result()
        if len(query):
            values = pa.array(np.where(np.isposinf(score), np.nan, score), mask=np.isneginf(score))
            yield from _headed(heads, query, doc_id=id_array(ids, kind), score=values)

    return run
