"""Op 4: PNG media columns.

Texts become 8-bit greyscale PNG files in the binary column of a stored table: zlib-compressed IDAT, a
CRC on every chunk, scanline filters chosen per row.  The table is read again for all that follows:
reading tests the signature and each checksum, inflates,
undoes all five filters with numpy and describes the picture by the signs of its low-frequency
cosine coefficients.  Each row is handled alone, so nothing is shuffled and no group can be hot.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from precioscope.llm.scratch import Scratch

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
HASH_SIDE = 8
GRID = 32


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 padded with spaces to a positive multiple of 192, length before padding)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale PNG whose samples are ``payload``; its length must be a multiple of ``width``.

    Each row takes the one of the filters None, Sub and Up whose residuals are least in sum, as the
    PNG standard advises.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in (rows, sub, up)])
    kind = cost.argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    for k, filtered in enumerate((rows, sub, up)):
        own = kind == k
        lines[own, 1:] = filtered[own]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Samples of filtered scanlines (first byte: filter 0 to 4)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown PNG filter")
    height, width = out.shape
    own = kinds == 1
    if own.any():
        deltas = out[own].reshape(-1, width // bpp, bpp)
        out[own] = np.cumsum(deltas, axis=1, dtype=np.uint8).reshape(-1, width)
    for y in np.flatnonzero(kinds > 1):
        row, prior = out[y], out[y - 1] if y else np.zeros(width, np.uint8)
        if kinds[y] == 2:
            row += prior
            continue
        line, above = row.tolist(), prior.tolist()
        for x in range(width):
            a, b = (line[x - bpp] if x >= bpp else 0), above[x]
            if kinds[y] == 3:
                guess = (a + b) // 2
            else:
                c = above[x - bpp] if x >= bpp else 0
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
            line[x] = (line[x] + guess) & 255
        out[y] = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG; ValueError if a checksum or the structure is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut-off chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(part) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + part)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a complete 8-bit greyscale PNG")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(lines.reshape(height, width + 1))


def _cosines() -> np.ndarray:
    k, x = np.arange(HASH_SIDE + 1)[:, None], np.arange(GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * GRID))


_COSINES = _cosines()


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as hex: is each low-frequency cosine coefficient above their median?

    The picture is averaged down to a 32 x 32 grid (bands of rows and columns; a short picture
    repeats rows), as a perceptual hash does.
    """
    h, w = image.shape
    edges = lambda n: np.minimum(np.arange(GRID) * n // GRID, n - 1)
    ys, xs = edges(h), edges(w)
    rows = np.add.reduceat(image.astype(np.int64), np.unique(ys), axis=0)
    counts = np.diff(np.append(np.unique(ys), h))
    rows = (rows / counts[:, None])[np.searchsorted(np.unique(ys), ys)]
    grid = np.add.reduceat(rows, np.unique(xs), axis=1) / np.diff(np.append(np.unique(xs), w))
    low = (_COSINES @ grid @ _COSINES.T)[1:, 1:]
    return np.packbits(np.round(low, 6) > np.median(np.round(low, 6))).tobytes().hex()


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Bytes of rows of a result batch, so that long texts do not gather in memory.
BATCH_BYTES = 4 << 20


def _batched(rows: Iterator[tuple], schema: str, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    held, held_bytes = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], kinds[k]) for c, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if held_bytes > BATCH_BYTES or len(held) >= 1024:
            yield out()
            held, held_bytes = [], 0
    yield out()


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and the text as PNG in the binary column ``media``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            for i, text in enumerate(batch.column(1)):
                payload, n = payload_of(text.as_py())
                yield ids[i], n, encode_png(payload)

    return docs.select("doc_id", "text").mapInArrow(lambda batches: _batched(rows(batches), MEDIA_SCHEMA, lambda r: len(r[2])), MEDIA_SCHEMA)


def read_media(media: DataFrame) -> DataFrame:
    """Of a table (doc_id, n_bytes, media): each picture read, its checksums tested, and described.

    A picture that fails a checksum ends the job: nothing is described that was not read back whole.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, picture in enumerate(batch.column(2)):
                data = picture.as_py()
                image = decode_png(data)
                back = image.tobytes()
                yield ids[i], sizes[i], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _batched(rows(batches), SCHEMA, lambda r: 256), SCHEMA)


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as PNG in a table's binary column, read back and described.

    ``docs`` needs doc_id and text; other columns are ignored.  Null and empty text give one row of
    192 spaces.  Equal texts give equal values, repeated rows stay, an empty table gives none.
    """
    return read_media(Scratch(docs.sparkSession, "media").cut(media_table(docs), "media"))
