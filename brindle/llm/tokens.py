"""Token ids of whole corpora in ORC files: encoded, written in document order, read by stripe.

Documents are dealt into ranges of ids, so each file holds ascending ids and files ascend too.
ORC run-length-encodes the integers, keeps row indexes every ``row_stride`` rows, minima and maxima
for each stripe, and Bloom filters on the document id: a reader skips files, stripes and row groups
by metadata (``read_tokens``), and Spark splits large files between stripes.

Encoding is the library's ``encode(text, add_special_tokens=False)``.  Texts of common Latin letters,
digits, signs and blanks take a short cut where the tokenizer is a plain byte-level merge model:
numpy finds the bounds of all pieces of a slice of texts by the tokenizer's published pattern, looks
their bytes up in a table, and gathers the ids; each piece that is new goes once through the
library's merge model, which is the same as encoding the text.  Any other text, any text that holds
the string of an added token, and all texts of any other tokenizer go through the library whole.

Cases: a null or empty text has just the end id; texts of any length are encoded whole; null ids
come first; rows with equal ids stand by text and each has its own start; an empty table gives an
empty, readable data set; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import byte_set, mix, slices
from .shared import bound_batches, shuffle_width, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 400_000
_SLOT_BITS = 20
#: Bytes of text that are encoded at once.
_SLICE = 1 << 19
#: Pieces of up to so many bytes are looked up in the table.
_SHORT = 24

_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = _BLANK
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
#: Bytes that no text of the short cut has: controls, and the first bytes of characters beyond U+017F or below U+00C0.
_FOREIGN = byte_set(bytes([*range(9), *range(14, 32), 127, *range(0xC0, 0xC3), *range(0xC6, 256)]))
#: Second bytes of the two signs between U+00C0 and U+017F.
_SIGN_TAILS = byte_set(b"\x97\xb7")
#: Endings that stand alone after an apostrophe.
_ONE, _TWO = byte_set(b"stmd"), ((ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l")))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else the next free one from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printable else chr(next(free)) for b in range(256)}


def foreign_rows(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows hold a character that the short cut does not know."""
    bad = _FOREIGN[buf]
    bad[1:] |= _SIGN_TAILS[buf[1:]] & (buf[:-1] == 0xC3)
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = True
    return out


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows begin.

    A piece is a run of letters, of digits or of other signs, with the one blank (20) before it; what
    else there is of white space before it is a piece of its own, and so is an apostrophe with one of
    the endings, where a piece begins at the apostrophe.
    """
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[buf]
    cut[1:n] = kind[1:] != kind[:-1]
    cut[off] = True
    edges = np.flatnonzero(cut)
    begin, end = edges[:-1], edges[1:]
    last_of_row = np.zeros(n + 1, bool)
    last_of_row[off] = True
    inner = ~last_of_row[end]
    of = kind[begin]
    gap = end[(of == _BLANK) & inner]
    cut[gap - 1] = True
    cut[gap[buf[gap - 1] == 32]] = False
    # an apostrophe alone, at the beginning of a piece, and then letters
    quote = np.flatnonzero((of == _SIGN) & inner & (end - begin == 1) & (buf[begin] == 39) & cut[begin])
    quote = quote[of[np.minimum(quote + 1, len(of) - 1)] == _LETTER]
    if len(quote):
        at, stop = end[quote], end[quote + 1]
        first, second = buf[at], buf[np.minimum(at + 1, n - 1)]
        two = np.zeros(len(at), bool)
        for x, y in _TWO:
            two |= (first == x) & (second == y)
        size = np.where(_ONE[first], 1, np.where(two & (stop - at >= 2), 2, 0))
        at, size = at[size > 0], size[size > 0]
        cut[at] = False
        cut[at + size] = True
    return np.flatnonzero(cut[:n])


class Pieces:
    """Ids of distinct pieces by their bytes: an open-addressed table that whole columns are looked up in at once.

    Bytes are compared in full (three overlapping words of eight and the length), so a look-up is exact.
    A table that holds REMEMBERED pieces takes no more; further ones are encoded in every slice anew.
    """

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()
        self.ids, self.start = array("i"), array("q", [0])
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.words = np.zeros((1 << _SLOT_BITS, 4), np.uint64)
        self.kept = 0

    def forget(self) -> None:
        """Drop the ids of pieces that the table does not hold."""
        del self.start[self.kept + 1 :]
        del self.ids[self.start[-1] :]

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers for new pieces (none has a byte 0)."""
        begin = len(self.start) - 1
        apart = self.letters[0]
        for letters in b"\0".join(pieces).decode("latin-1").translate(self.letters).split(apart):
            self.ids.extend([x.id for x in self.model.tokenize(letters)])
            self.start.append(len(self.ids))
        return np.arange(begin, begin + len(pieces))

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every piece."""
        n = ends - starts
        padded = np.concatenate([buf, np.zeros(_SHORT, np.uint8)])
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        word = lambda p: eight[p].view("<u8").ravel()
        masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
        key = np.zeros((len(n), 4), np.uint64)
        key[:, 0] = word(starts) & masks[np.minimum(n, 8)]
        key[:, 3] = n
        for k, least in ((1, 8), (2, 16)):  # the last eight bytes, and those from the ninth on
            more = np.flatnonzero(n > least)
            key[more, k] = word(ends[more] - 8 if k == 1 else starts[more] + 8)
        h = mix(key[:, 0] ^ mix(key[:, 1] ^ mix(key[:, 2] + key[:, 3])))
        out, slot = self._find(key, h)
        left = np.flatnonzero((out < 0) & (n <= _SHORT))
        while len(left):
            _, first = np.unique(h[left], return_index=True)
            new = left[first]
            k = self._add([buf[starts[i] : ends[i]].tobytes() for i in new.tolist()])
            own, keys = h[new], key[new]
            room = max(0, REMEMBERED - self.kept)
            self._insert(slot[new[:room]], keys[:room], k[:room])
            # equal hashes of different pieces wait for another round
            at = np.searchsorted(own, h[left])
            mine = (keys[at] == key[left]).all(1)
            out[left[mine]] = k[at[mine]]
            left = left[~mine]
            if len(left):
                out[left], slot[left] = self._find(key[left], h[left])
                left = left[out[left] < 0]
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(n > _SHORT).tolist():
            piece = buf[starts[i] : ends[i]].tobytes()
            if piece not in known:
                known[piece] = int(self._add([piece])[0])
            out[i] = known[piece]
        return out

    def _find(self, key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of known pieces (else -1), and the slot where each search ended."""
        slot = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        k = self.slots[slot]
        out = np.where((self.words[slot] == key).all(1), k, -1).astype(np.int64)
        todo = np.flatnonzero((out < 0) & (k >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
            s = slot[todo]
            k = self.slots[s]
            same = (k >= 0) & (self.words[s] == key[todo]).all(1)
            out[todo[same]] = k[same]
            todo = todo[~same & (k >= 0)]
        return out, slot

    def _insert(self, slot: np.ndarray, key: np.ndarray, number: np.ndarray) -> None:
        """Put pieces into the next free slots from ``slot`` on; their numbers follow those of the pieces kept."""
        todo, slot = np.arange(len(slot)), slot.copy()
        while len(todo):
            s = slot[todo]
            _, first = np.unique(s, return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= self.slots[s] < 0
            self.slots[s[won]], self.words[s[won]] = number[todo[won]], key[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
        self.kept += len(number)


class Encoder:
    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer
        if not os.path.isabs(tokenizer):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.marks = [t["content"].encode() for t in spec["added_tokens"]]
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain_split = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        #: Whether the short cut's pattern and letters are this tokenizer's.
        self.plain = bool(plain_split and spec.get("normalizer") is None and model["type"] == "BPE" and not any(model.get(x) for x in odd) and spec.get("truncation") is None)
        self.pieces = Pieces(self.library.model)

    def whole_rows(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which rows must go through the library whole."""
        if not self.plain:
            return np.ones(len(off) - 1, bool)
        out = foreign_rows(buf, off)
        raw = buf.tobytes()
        for mark in self.marks:
            at = raw.find(mark) if mark else -1
            while at >= 0:
                out[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(mark, at + 1)
        return out

    def rows(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each row has."""
        whole = self.whole_rows(buf, off)
        starts = piece_starts(buf, off)
        ends = np.append(starts[1:], len(buf))
        first = np.searchsorted(starts, off)
        if whole.any():
            mine = np.repeat(~whole, np.diff(first))
            starts, ends = starts[mine], ends[mine]
            first = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(first)))])
        k = self.pieces.numbers(buf, starts, ends)
        ids, start = np.frombuffer(self.pieces.ids, np.int32), np.frombuffer(self.pieces.start, np.int64)
        n = start[k + 1] - start[k]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.arange(upto[-1]) + np.repeat(start[k] - upto[:-1], n)]
        count = upto[first[1:]] - upto[first[:-1]]
        del ids, start
        self.pieces.forget()
        if not whole.any():
            return flat, count
        own = {i: self.library.encode(buf[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in np.flatnonzero(whole).tolist()}
        for i, x in own.items():
            count[i] = len(x)
        out = np.empty(count.sum(), np.int32)
        from_library = np.repeat(whole, count)
        out[~from_library] = flat
        out[from_library] = np.fromiter((x for i in sorted(own) for x in own[i]), np.int32)
        return out, count

    def __call__(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.rows(raw, np.array([0, len(raw)]))[0]


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(tokenizer: str) -> Encoder:
    """This worker process's encoder, kept between tasks."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def ended_rows(column: pa.Array, tokenizer: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a string column with their numbers of ids and all ids, each row's end id included."""
    encoder = worker_encoder(tokenizer)
    for a, b, buf, off in slices(column, _SLICE):
        ids, count = encoder.rows(buf, off)
        ends = np.cumsum(count + 1)
        flat = np.empty(ends[-1], np.int32)
        mask = np.ones(ends[-1], bool)
        mask[ends - 1] = False
        flat[mask] = ids
        flat[ends - 1] = end_id
        yield a, b, count + 1, flat


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, begin, n, tokens) in document order: ``begin`` counts the ids before it in its part."""
    bound_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("__text"))
    ranged = kept.repartitionByRange(shuffle_width(docs.sparkSession), id_col).sortWithinPartitions(id_col, "__text")
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, part int, begin long, n long, tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, n, flat in ended_rows(batch.column(1), tokenizer, end_id):
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(total + ends - n), pa.array(n), lists],
                    names=[id_col, "part", "begin", "n", "tokens"],
                )
                total += int(ends[-1])

    return ranged.mapInArrow(run, schema)


def write_tokens(encoded: DataFrame, path: str, id_col: str = "doc_id", stripe_bytes: int = 16 << 20, row_stride: int = 1000) -> None:
    """One ORC file for each range of documents."""
    bound_batches(encoded.sparkSession)
    (
        encoded.write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, schema, ids: list[int] | None = None, between: tuple[int, int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The written rows; filters on the id reach the files' statistics and Bloom filters."""
    bound_batches(spark)
    rows = spark.read.schema(schema).orc(path)
    if between:
        rows = rows.where(F.col(id_col).between(*between))
    return rows.where(F.col(id_col).isin(ids)) if ids is not None else rows


def token_digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of written rows; only the sums of the parts, a row each, are broadcast."""
    parts = rows.groupBy("part").agg(F.sum("n").alias("__n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            off = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "part", "begin", "n_tokens", "ids_crc32"])

    read = rows.select(id_col, "part", "begin", "tokens").mapInArrow(run, f"`{id_col}` {kind}, part int, begin long, n_tokens long, ids_crc32 long")
    joined = read.join(F.broadcast(starts), F.col("part") == F.col("__p"))
    return joined.select(id_col, (F.col("begin") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32")
