"""Media columns: PNG files held in binary columns, and perceptual hashes of what they show.

``encode_png`` writes an 8-bit grey image as signature, IHDR, IDAT chunks of one zlib stream and
IEND, each chunk with its CRC.  ``decode_png`` checks every CRC and length before it inflates the
stream and reverses the five scan-line filters with numpy.  ``grey_hash`` keeps the signs of the
lowest frequencies of a cosine transform, so it survives rescaling and mild noise.

Cases: a null text or payload counts as empty, an empty payload becomes one block of padding;
equal payloads give equal files and hashes; a null, truncated or altered file gives null features
and a non-null ``error``.  Rows are independent, so hot keys, repeats and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .shared import text_or_empty

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payloads are padded with PAD to whole blocks of 24 x 24 samples.
BLOCK = 576
PAD = 255
#: Lines hold 24 samples or one of these multiples, so that blocks always fill them.
LINES = (24, 48, 72, 96, 144, 192, 288, 576)
IDAT_BYTES = 1 << 16
#: Deflate cannot shrink anything further than by about this factor.
DEFLATE_LIMIT = 1100
#: Lines whose diagonals are reversed together.
DIAGONAL_LINES = 256


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(img: np.ndarray, kind: int) -> np.ndarray:
    """The residual of every line under one filter type, modulo 256."""
    left = np.zeros_like(img)
    left[:, 1:] = img[:, :-1]
    up = np.zeros_like(img)
    up[1:] = img[:-1]
    if kind == 0:
        return img
    if kind == 1:
        return img - left
    if kind == 2:
        return img - up
    if kind == 3:
        return img - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(img)
    corner[1:, 1:] = img[:-1, :-1]
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    return img - _paeth(a, b, c).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    da, db, dc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def _entropy(x: np.ndarray) -> float:
    n = np.bincount(x.ravel(), minlength=256)
    n = n[n > 0] / x.size
    return float(-(n * np.log2(n)).sum())


def line_width(n: int) -> int:
    """The longest permitted line that leaves an image of ``n`` samples no wider than high."""
    return max((w for w in LINES if w * w <= n), default=LINES[0])


def encode_png(payload: bytes, width: int, filters: int | np.ndarray | None = None) -> bytes:
    """A grey image whose samples are ``payload`` (a positive multiple of ``width``).

    ``filters``: one type, one per line, or None for whichever of none, sub and up leaves the
    residual of least entropy.
    """
    img = np.frombuffer(payload, np.uint8).reshape(-1, width)
    if filters is None:
        filters = min((0, 1, 2), key=lambda k: (_entropy(_filtered(img, k)), k))
    kinds = np.broadcast_to(np.asarray(filters, np.uint8), len(img))
    lines = np.empty((len(img), width + 1), np.uint8)
    lines[:, 0] = kinds
    for k in np.unique(kinds):
        lines[kinds == k, 1:] = _filtered(img, int(k))[kinds == k]
    body = zlib.compress(lines.tobytes(), 6)
    head = struct.pack(">IIBBBBB", width, len(img), 8, 0, 0, 0, 0)
    idat = b"".join(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + idat + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Samples from residual lines; runs of lines of one type are reversed together where numpy can."""
    if not kinds.any():
        return x
    out = np.empty_like(x)
    above = np.zeros(x.shape[1], np.uint8)
    edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]).tolist() + [len(kinds)]
    for a, b in zip(edges, edges[1:]):
        kind = int(kinds[a])
        if kind == 0:
            out[a:b] = x[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(x[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([above, x[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(a, b, DIAGONAL_LINES):
                end = min(b, y + DIAGONAL_LINES)
                out[y:end] = _diagonals(kind, x[y:end], above)
                above = out[end - 1]
        else:
            raise ValueError(f"filter type {kind}")
        above = out[b - 1]
    return out


def _diagonals(kind: int, x: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth lines: a sample needs those to its left and above, so whole diagonals are reversed at once."""
    height, width = x.shape
    place = np.arange(height)
    rest = np.zeros((height + width - 1, height), np.int16)  # row t has the samples whose line and column add up to t
    for y in range(height):
        rest[y : y + width, y] = x[y]
    top = np.concatenate([[0], above.astype(np.int16), np.zeros(height, np.int16)])
    before, last = np.zeros(height, np.int16), np.zeros(height, np.int16)
    out = np.empty_like(rest)
    for t in range(len(rest)):
        up, corner = np.roll(last, 1), np.roll(before, 1)
        up[0], corner[0] = top[t + 1], top[t]
        now = (rest[t] + ((last + up) >> 1 if kind == 3 else _paeth(last, up, corner))) & 255
        now[(place > t) | (place < t - width + 1)] = 0
        out[t] = now
        before, last = last, now
    return np.stack([out[y : y + width, y] for y in range(height)]).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The samples (lines by columns) of an 8-bit grey PNG; ValueError if any check fails.

    Inflation stops at the size that the header gives, which may not be beyond what deflate can reach.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, seen, ended = 8, None, [], b"", False
    while at < len(data):
        if ended:
            raise ValueError("data after IEND")
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, end = data[at + 4 : at + 8], at + 8 + n
        if end + 4 > len(data):
            raise ValueError("truncated chunk")
        if zlib.crc32(data[at + 4 : end]) != struct.unpack_from(">I", data, end)[0]:
            raise ValueError(f"checksum of {kind!r}")
        if (kind == b"IHDR") != (head is None):
            raise ValueError("IHDR must be the first chunk and no other")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("length of IHDR")
            head = struct.unpack(">IIBBBBB", data[at + 8 : end])
        elif kind == b"IDAT":
            if body and seen != b"IDAT":
                raise ValueError("IDAT chunks apart")
            body.append(data[at + 8 : end])
        elif kind != b"IEND" and not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
        ended, seen = kind == b"IEND", kind
        at = end + 4
    if head is None or not ended:
        raise ValueError("missing IHDR or IEND")
    width, height, *kind_of = head
    if kind_of != [8, 0, 0, 0, 0]:
        raise ValueError("only plain 8-bit grey images")
    packed, size = b"".join(body), height * (width + 1)
    if not width or not height or size > DEFLATE_LIMIT * len(packed):
        raise ValueError("size of the image")
    inflate = zlib.decompressobj()
    try:
        raw = np.frombuffer(inflate.decompress(packed, size + 1), np.uint8)
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if len(raw) != size or not inflate.eof or inflate.unused_data:
        raise ValueError("wrong number of samples")
    lines = raw.reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    """The first ``k`` rows of the orthonormal DCT-II matrix of size ``n``."""
    m = np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


_SIDE, _KEEP = 32, 8
_DCT = _cosines(_SIDE, _KEEP)


def _shrunk(img: np.ndarray, axis: int) -> np.ndarray:
    n = img.shape[axis]
    if n < _SIDE:
        return np.take(img, np.arange(_SIDE) * n // _SIDE, axis=axis)
    edges = np.arange(_SIDE + 1) * n // _SIDE
    shape = [1, 1]
    shape[axis] = _SIDE
    return np.add.reduceat(img, edges[:-1], axis=axis, dtype=np.float64) / np.diff(edges).reshape(shape)


def grey_hash(img: np.ndarray) -> bytes:
    """Eight bytes: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 mean image pass their median."""
    small = _shrunk(_shrunk(img, 0), 1)
    low = (_DCT @ small @ _DCT.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of a block."""
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def stored(raw: bytes) -> bytes:
    payload = padded(raw)
    return encode_png(payload, line_width(len(payload)))


def texts_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as the samples of one PNG."""
    kept = df.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("__text"))
    ids = kept.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in slices(batch.column(1)):
                media = [stored(buf[off[i] : off[i + 1]].tobytes()) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return kept.mapInArrow(run, f"`{ids.name}` {ids.dataType.simpleString()}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary, feature string, error string"


def _features(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7 + ("null",)
    file = (len(media), hashlib.sha256(media).hexdigest())
    try:
        img = decode_png(media)
    except ValueError as e:
        return (None, None, None, *file, None, None, str(e))
    payload = img.tobytes()
    seen = grey_hash(img)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *file, seen, seen.hex(), None)


def media_features(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), media_col: str = "media") -> DataFrame:
    """The id columns and, read back from each stored file, the features of its samples."""
    kept = df.select(*id_cols, F.col(media_col).alias("__media"))
    ids = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in id_cols)
    n = len(id_cols)
    names = [*id_cols, *(x.split()[0] for x in FEATURES.split(", "))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(x.as_py()) for x in batch.column(n)]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + cols, names=names)

    return kept.mapInArrow(run, f"{ids}, {FEATURES}")
