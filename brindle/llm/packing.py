"""Best-fit packing of token ids into sequences of several permitted lengths.

Every text is encoded (``tokens``), its end id included.  Texts longer than the longest sequence are
cut into pieces of that length; all other pieces are whole texts.  Pieces are taken by descending
length.  One goes into the open bin, of whatever capacity, that it leaves the least room in, of
several such bins into the one opened last; if it fits nowhere, a bin opens.  Of the capacities that can hold the piece the one opens that costs least
for each token that it may come to hold: the piece, and as much of the remaining room as pieces
still to come that are no longer than it could fill.  At the end each bin shrinks to the smallest
permitted capacity that holds its contents.

Packing is sequential, so pieces are dealt into shards of about ``SHARD_BYTES`` of text by a hash of
their id, text and place, and each shard is packed on its own: the number of shards grows with the
input, their memory does not, each wastes at most a few bins, and the result does not depend on how
the input is partitioned.  Rows alike in id and text go to one shard, where they are numbered as
copies; only where one such row occurs more than ``REPEATS`` times are its copies spread at random.

A row of the result is one sequence: its ids, and for each piece in it where it comes from.

Cases: a null or empty text is one piece of one (end) token; ties are broken by id, text and piece;
repeated rows are packed as often as they occur; null ids are packed like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, text_or_empty
from .tokens import END_ID, TOKENIZER, ended_rows

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_BYTES = 4 << 20
REPEATS = 1000


class Cost(NamedTuple):
    """What a sequence costs: a fixed part, its length, and its length squared over ``square``."""

    fixed: float = 64.0
    square: float = 16384.0

    def of(self, capacity: int) -> float:
        return self.fixed + capacity + capacity * capacity / self.square


def opening(k: int, lengths: list[int], upto: np.ndarray, capacities: tuple[int, ...], cost: Cost) -> int:
    """The capacity to open for piece ``k`` of the descending ``lengths``, whose running sums are ``upto``."""

    def rate(c: int) -> tuple[float, int]:
        room = c - lengths[k]
        first = max(k + 1, bisect_left(lengths, -room, key=lambda n: -n))  # pieces from here on fit the room
        return cost.of(c) / (lengths[k] + min(room, int(upto[-1] - upto[first]))), c

    return min((c for c in capacities if c >= lengths[k]), key=rate)


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Cost = Cost()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in descending order: the bin, the offset in it and the bin's final capacity."""
    room: list[list[int]] = [[] for _ in range(max(capacities) + 1)]  # heaps of bins, the last first, by what they can still hold
    open_mask = 0  # bit r: some bin has room r
    used: list[int] = []
    each = lengths.tolist()
    upto = np.concatenate([[0], np.cumsum(lengths)])
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(each):
        fits = open_mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = -heappop(room[r])
            if not room[r]:
                open_mask ^= 1 << r
        else:
            b, r = len(used), opening(k, each, upto, capacities, cost)
            used.append(0)
        where[k], offset[k] = b, used[b]
        used[b] += n
        left = r - n
        if left:
            if not room[left]:
                open_mask |= 1 << left
            heappush(room[left], -b)
    ordered = np.array(sorted(capacities))
    final = ordered[np.searchsorted(ordered, np.array(used, np.int64))] if used else np.zeros(0, np.int64)
    return where, offset, final[where] if len(lengths) else np.zeros(0, np.int64)


def token_pieces(docs: DataFrame, longest: int, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, piece, start, tokens): the ids of every text, cut every ``longest``; ``h`` is a hash of the text."""
    text = text_or_empty(text_col)
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n, flat in ended_rows(batch.column(2), tokenizer, end_id):
                cuts = -(-n // longest)
                row = np.repeat(np.arange(b - a), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                size = np.minimum(longest, n[row] - piece * longest)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(own), batch.column(1).slice(a, b - a).take(own), pa.array(piece.astype(np.int32)), pa.array(piece * longest), lists],
                    names=["id", "h", "piece", "start", "tokens"],
                )

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, h long, piece int, start long, tokens array<int>")


def sequences_of(table: pa.Table, shard: int, capacities: tuple[int, ...], cost: Cost) -> pa.Table:
    """The sequences of one shard's pieces."""
    table = table.append_column("n", pc.list_value_length(table["tokens"]))
    order = [("n", "descending"), ("id", "ascending"), ("h", "ascending"), ("piece", "ascending")]
    table = table.take(pc.sort_indices(table, order)).combine_chunks()
    n = table["n"].to_numpy().astype(np.int64)
    where, offset, capacity = pack(n, capacities, cost)
    alike = np.ones(len(n), bool)
    same = [pc.equal(table[c].slice(1), table[c].slice(0, len(n) - 1)) for c in ("id", "h", "piece")]
    nulls = table["id"].is_null().to_numpy()
    if len(n) > 1:
        ids = same[0].fill_null(False).to_numpy() | (nulls[1:] & nulls[:-1])
        alike[1:] = ~(ids & same[1].to_numpy() & same[2].to_numpy())
    begin = np.flatnonzero(alike)
    copy = np.arange(len(n)) - np.repeat(begin, np.diff(np.append(begin, len(n))))
    placed = np.lexsort((offset, where))
    rows = table.take(pa.array(placed)).combine_chunks()
    bins, first, count = np.unique(where[placed], return_index=True, return_counts=True)
    upto = np.concatenate([[0], np.cumsum(n[placed])])
    edges = np.append(first, len(n))
    tokens = pa.ListArray.from_arrays(pa.array(upto[edges], pa.int32()), pc.list_flatten(rows["tokens"]).combine_chunks())
    parts = pa.StructArray.from_arrays(
        [rows["id"].combine_chunks(), pa.array(copy[placed].astype(np.int32)), rows["piece"].combine_chunks(), rows["start"].combine_chunks(), pa.array(offset[placed].astype(np.int32)), pa.array(n[placed].astype(np.int32))],
        names=["id", "copy", "piece", "start", "offset", "length"],
    )
    return pa.table(
        {
            "bin_id": pa.array((np.int64(shard) << 32) + bins),
            "capacity": pa.array(capacity[placed][first].astype(np.int32)),
            "n_tokens": pa.array(np.diff(upto[edges]).astype(np.int32)),
            "tokens": tokens,
            "parts": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts),
        }
    )


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    capacities: tuple[int, ...] = CAPACITIES,
    cost: Cost = Cost(),
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(bin_id, capacity, n_tokens, tokens, parts), one row for each sequence.

    ``parts`` says, for the pieces in order, of which document (``id``, and which ``copy`` of it in
    its shard), which ``piece`` and from which id of the text on (``start``), and where they stand
    (``offset``, ``length``).
    """
    bound_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    alike = docs.groupBy(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__h")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.octet_length(text) + 1).alias("__bytes"))
    size = alike.agg(F.sum("__bytes").alias("bytes"), F.max("__n").alias("most")).first()
    shards = max(1, -(-(size["bytes"] or 0) // shard_bytes))
    pieces = token_pieces(docs, max(capacities), tokenizer, end_id, id_col, text_col)
    salt = F.lit(0).cast("long")
    if (size["most"] or 0) > REPEATS:
        often = alike.where(F.col("__n") > REPEATS).select("__id", "__h", F.lit(True).alias("__often"))
        pieces = pieces.join(often, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")), "left")
        salt = F.when(F.col("__often"), F.monotonically_increasing_id()).otherwise(salt)
    shard = F.pmod(F.xxhash64("id", "h", "piece", salt), F.lit(shards)).cast("int")
    dealt = pieces.select("id", "h", "piece", "start", "tokens", shard.alias("shard"))
    kind = pieces.schema["id"].dataType.simpleString()
    part = f"struct<id:{kind},copy:int,piece:int,start:long,offset:int,length:int>"

    def run(table: pa.Table) -> pa.Table:
        return sequences_of(table.drop_columns(["shard"]), table["shard"][0].as_py(), capacities, cost)

    return dealt.groupBy("shard").applyInArrow(run, f"bin_id long, capacity int, n_tokens int, tokens array<int>, parts array<{part}>")
