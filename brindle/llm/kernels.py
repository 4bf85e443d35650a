"""Vectorised text kernels shared by the Arrow-backed operators.

An Arrow string column is one contiguous UTF-8 buffer plus offsets, so words can be found and
hashed for a whole slice of rows at once, without a Python loop over words.  Word and shingle ids
are 64-bit values from a polynomial over the bytes, finished by an avalanche mix.

Cases: null rows are empty ones; empty rows have no word; a row longer than a slice is a slice of its
own; an empty column gives no slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, step in enumerate((_BASE, _INVERSE)):
            out = np.full(size, np.uint64(step))
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on unsigned 64-bit values (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(text: bytes) -> np.ndarray:
    """A 256-entry table that is True at the bytes of ``text``."""
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


#: Bytes that part words for the white-space rule: space and 09 to 0D.
NOT_SPACE = ~byte_set(b" \t\n\x0b\x0c\r")
#: Bytes of the alphanumeric rule: 0-9, a-z and everything beyond ASCII.
ALNUM = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a string column with their bytes and offsets from 0; nulls are empty.

    A slice holds at most ``limit`` bytes unless one row alone is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and for each row the index of its first word (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1] | cut[1:n]
    end[:-1] &= ~m[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit ids of byte spans; equal bytes give equal ids wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def pairs(ids: np.ndarray) -> np.ndarray:
    """Ids of adjacent word pairs (one fewer than words)."""
    return mix(ids[:-1] * np.uint64(0xD6E8FEB86659FD93) + ids[1:])


def distinct_per_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each row's values and drop repeats; ``counts`` says how many belong to each row."""
    if not len(values):
        return values, counts
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.bincount(r[keep], minlength=len(counts))


#: Classes of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 other signs.
TOKEN_CLASS = np.full(256, 2, np.uint8)
TOKEN_CLASS[list(b" \t\n\x0b\x0c\r")] = 0
TOKEN_CLASS[ALNUM] = 1
TOKEN_CLASS[65:91] = 1


def token_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``word_bounds``, for the longest runs of letters and of other signs."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = TOKEN_CLASS[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    turn = np.ones(n + 1, bool)
    turn[1:n] = kind[1:] != kind[:-1]
    turn |= cut
    starts = np.flatnonzero(turn[:n] & (kind > 0))
    ends = np.flatnonzero(turn[1:] & (kind > 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; ``first`` as from ``word_bounds``."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
