"""Vectorised text primitives over the buffers of Arrow string columns.

Words, lines and shingles are found and hashed by numpy for many documents at once; no Python
string is made.  Texts are taken whole: a chunk ends between documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        for i, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    if column.type in (pa.string(), pa.binary()):
        column = column.cast(pa.binary())
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"", kind))
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunked(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of whole texts of about ``most`` bytes."""
    offsets, data = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of non-space bytes; no run crosses documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~is_space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_or(~word[:-1], cut[1:-1], out=before[1:])
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_or(~word[1:], cut[1:-1], out=after[:-1])
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; A-Z count as a-z if ``lower``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64))


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes of ``size``-word shingles, A-Z lower-cased, document by document.

    A document of fewer words gives its whole sequence as one shingle; one without words gives none.
    Hashes of document i lie in hashes[bounds[i]:bounds[i + 1]], repeats included.
    """
    start, end, doc = spans(data, offsets)
    n = len(offsets) - 1
    w = hash_spans(data, start, end, lower=True)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    if not len(w):
        return w, np.zeros(n + 1, np.int64)
    h = np.zeros(len(w), np.uint64)
    for k in range(size):
        part = mix(w + np.uint64((k + 1) * int(_BASE) & (1 << 64) - 1))
        h[: len(w) - k] += part[k:]
    full = np.maximum(words - size + 1, 0)
    keep = np.arange(len(w)) < (first[:-1] + full)[doc]
    short = np.flatnonzero((words > 0) & (full == 0))
    for i in short:
        a, b = first[i], first[i + 1]
        ks = np.arange(1, b - a + 1, dtype=np.uint64)
        h[a] = mix(w[a:b] + ks * _BASE).sum() + np.uint64(b - a)
        keep[a] = True
    counts = np.where(words > 0, np.maximum(full, 1), 0)
    return mix(h[keep]), np.concatenate([[0], np.cumsum(counts)])
