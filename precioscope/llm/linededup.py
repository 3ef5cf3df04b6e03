"""Op 5: fuzzy line deduplication by MinHash.

Equal lines are one representative, told by a 128-bit BLAKE2 hash of the normalised line.  Others are
compared as sets of character shingles: a signature of minima over bins of a permutation (empty bins
borrow) is cut into bands of ROWS values, lines that agree in a band meet in a tile, are bounded by
parity bitmaps, verified by exact Jaccard and merged by distributed union-find (linking.py).  Of a
component only its first line is kept, in the order of (doc_id, line number).

Lines of fewer than FEW shingles would borrow most of the bins of one permutation and meet by chance,
so each of their bands has a permutation of its own; lines of at least FEW * percent shingles have
the bands of one permutation (as well), so similar lines always have a scheme in common.  With 12
bands of 5 values two lines of similarity 0.8 meet with probability 0.991, of 0.9 with more than
0.9999.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.llm.arrowtext import buffers, chunked, mix
from precioscope.llm.linking import NAME_MASK, link_small_sets, shared_tiles, size_bits, sorted_set
from precioscope.llm.scratch import Scratch

SHINGLE = CORPUS_SHINGLE = 5
PERCENT = 80
LEAST_CHARS = 20
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
FEW = 100
SPOTS = 1024
SEEN_LINES = 200_000
LINE_SCHEMA = "doc_id long, tie long, line_no int, id binary, sizes int, keys array<long>"
MEMBER_SCHEMA = "id binary, elements binary"
_ODD = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.uint64).max
#: Odd multipliers, one for each band of short lines.
_TURNS = mix(np.arange(101, 101 + BANDS, dtype=np.uint64)) | np.uint64(1)
_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(99 << 32)
_FEW_SEEDS = (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(1)
#: Bytes of text at a time: their arrays stay in a core's cache.
TEXT_BYTES = 1 << 17
_TABLES: list[np.ndarray] = []
#: A-Z count as a-z, white space as a space; line ends stay.
_SAME = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 11, 12, 13) else c for c in range(256))


def _values() -> np.ndarray:
    """A random 64-bit value of each character."""
    if not _TABLES:
        _TABLES.append(mix(np.arange(1, 0x110001, dtype=np.uint64)))
    return _TABLES[0]


def _characters(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(code points, places of bytes among them) of texts one after another; in a text that is not
    UTF-8 bytes count as characters."""
    raw = np.frombuffer(data, np.uint8)
    try:
        chars = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        later = np.flatnonzero((raw & 0xC0) == 0x80)
        return chars, lambda at: at - np.searchsorted(later, at)
    except UnicodeDecodeError:
        bounds = np.asarray(bounds)
        if len(bounds) == 2:
            return raw.astype(np.uint32), lambda at: at
        parts = [_characters(data[a:b], np.array([0, b - a])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        first = [p[1](np.arange(b - a)) + e for p, a, b, e in zip(parts, bounds[:-1], bounds[1:], ends[:-1], strict=True)]
        first = np.concatenate([*first, ends[-1:]])
        return np.concatenate([p[0] for p in parts]), lambda at: first[at]


def shingle_hashes(chars: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the ``size`` characters from each place on (of fewer at the end)."""
    value = _values()[chars]
    out = value * np.uint64(_ODD)
    for k in range(1, min(size, len(chars))):
        out[: len(chars) - k] += value[k:]
        out *= np.uint64(_ODD)
    # Sums of odd multiples of evenly spread values are evenly spread.
    return out


def line_set(line: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted shingle hashes of a line given as its normalised bytes."""
    chars, _ = _characters(line, np.array([0, len(line)]))
    return np.unique(shingle_hashes(chars, size)[: max(1, len(chars) - size + 1)])


def line_bags(lines: list[bytes] | pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of many lines one after another, repeats included; number of each line's)."""
    offsets, data = buffers(lines if isinstance(lines, pa.Array) else pa.array(lines, pa.binary()))
    chars, place = _characters(data[offsets[0] : offsets[-1]].tobytes(), offsets - offsets[0])
    start = place(offsets - offsets[0])
    counts = np.maximum(np.diff(start) - size + 1, 1)
    return shingle_hashes(chars, size)[np.arange(counts.sum()) + np.repeat(start[:-1] - np.cumsum(counts) + counts, counts)], counts


def line_sets(lines: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sets of many lines, whose characters are hashed together."""
    values, counts = line_bags(lines, size)
    return list(map(sorted_set, np.split(values, np.cumsum(counts)[:-1])))


def _minima(x: np.ndarray, row: np.ndarray, lines: int, bins: int) -> np.ndarray:
    """Minima of each line's hashes in each bin; an empty bin takes the next full one's, marked by the distance.

    row: the line of each hash, times ``bins``.
    """
    low = np.full(lines * bins, _NONE, np.uint64)
    at = x >> np.uint64(32)
    at *= np.uint64(bins)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += row
    np.minimum.at(low, at, x)
    low = low.reshape(-1, bins)
    none = low == _NONE
    for shift in range(1, bins):
        if not none.any():
            break
        take = none & ~np.roll(none, -shift, axis=1)
        low = np.where(take, np.roll(low, -shift, axis=1) + np.uint64(shift * 0x51ED270B), low)
        none &= ~take
    return low


def _banded(low: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A key of each ROWS neighbouring minima, by seeds for each band; they are evenly spread numbers, so sums of odd multiples are."""
    key = mix(np.broadcast_to(seeds, (len(low), low.shape[1] // ROWS)))
    for r in range(ROWS):
        key = mix(key + low[:, r::ROWS])
    return key


def line_keys(h: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int = SHINGLE, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys line by line, number of each line's, size_bits of each) from the shingle hashes of characters;
    stop excludes the line's end."""
    count = stop - start - size + 1
    lines = len(count)
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(count)
    x = h[np.arange(ends[-1]) + np.repeat(start - ends + count, count)]
    # A line has at least as many different shingles as they have remainders modulo SPOTS.
    spots = np.zeros(lines * SPOTS, bool)
    spots[np.repeat(np.arange(0, lines * SPOTS, SPOTS), count) + (x & np.uint64(SPOTS - 1)).astype(np.int64)] = True
    least = spots.reshape(-1, SPOTS).sum(axis=1)
    few, many = least < FEW, count * 100 >= FEW * percent
    keys = np.zeros((lines, 2 * BANDS), np.uint64)
    if many.any():
        n = int(many.sum())
        # Lines that are not meant share a last row, which is left out.
        low = _minima(x, np.repeat(np.where(many, np.cumsum(many) - 1, n) * BINS, count), n + 1, BINS)
        keys[many, BANDS:] = _banded(low[:n], _SEEDS)
    if few.any():
        # An odd multiple of evenly spread hashes is another permutation of them; a row for each line and band.
        n = int(few.sum())
        xs = x[np.repeat(few, count)] * _TURNS[:, None]
        ls = np.repeat(np.arange(n) * ROWS, count[few]) + np.arange(0, BANDS * n * ROWS, n * ROWS)[:, None]
        low = _minima(xs.ravel(), ls.ravel(), BANDS * n, ROWS)
        keys[few, :BANDS] = _banded(low, np.repeat(_FEW_SEEDS, n)[:, None]).reshape(BANDS, n).T
    has = np.concatenate([few[:, None].repeat(BANDS, 1), many[:, None].repeat(BANDS, 1)], axis=1)
    return keys[has], has.sum(axis=1), size_bits(least, count)


def _signed(docs: DataFrame, least: int, size: int, percent: int, short: bool) -> DataFrame:
    """The lines of ``least`` characters, with ``short`` also those that have a letter or digit; once a task
    also the keys of a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
        seen: set[bytes] = set()  # bounded; a line's keys are given again if it was forgotten
        most = max(least, size)
        for batch in batches:
            for i, _, offsets, data in chunked(batch.column(2), TEXT_BYTES):
                text = data.tobytes().translate(_SAME)
                chars, place = _characters(text, offsets)
                breaks = np.flatnonzero(data == 10)
                head = np.union1d(offsets[:-1], breaks + 1)
                head = head[head < len(data)]
                doc = np.searchsorted(offsets, head, "right") - 1
                passed = np.searchsorted(breaks, head)
                tail = np.minimum(np.append(breaks, len(data))[passed], offsets[doc + 1])
                number = passed - np.searchsorted(breaks, offsets)[doc]
                start, stop = place(head), place(tail)
                wanted = stop - start >= least
                if short:
                    for k in np.flatnonzero(~wanted & (stop > start)).tolist():
                        wanted[k] = any(map(str.isalnum, map(chr, chars[start[k] : stop[k]].tolist())))
                if not wanted.any():
                    continue
                head, tail, doc, number, start, stop = (c[wanted] for c in (head, tail, doc, number, start, stop))
                digests = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(head.tolist(), tail.tolist(), strict=True)]
                given = stop - start >= most
                for k in np.flatnonzero(given).tolist():
                    if digests[k] in seen:
                        given[k] = False
                    else:
                        if len(seen) >= SEEN_LINES:
                            seen.clear()
                        seen.add(digests[k])
                keys, counts, bits = line_keys(shingle_hashes(chars, size), start[given], stop[given], size, percent)
                rows = len(digests)
                sizes = np.zeros(rows, np.int64)
                sizes[given] = counts
                told = np.zeros(rows, np.int32)
                told[given] = bits
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                keyed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)), mask=pa.array(~given))
                hashes = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, 16 * rows + 1, 16, np.int32)), pa.py_buffer(b"".join(digests))])
                at = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), hashes, pa.array(told), keyed], names=names)

    return docs.select("doc_id", "tie", "text").mapInArrow(run, LINE_SCHEMA)


def _members(docs: DataFrame) -> DataFrame:
    """(id, elements) of the wanted lines (numbers) of each document; elements are the line itself,
    which is smaller than its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEMBER_SCHEMA.split(", ")]
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for i, j, offsets, data in chunked(batch.column(0)):
                text, lines = data.tobytes().translate(_SAME), []
                for k in range(i, j):
                    own = text[int(offsets[k - i]) : int(offsets[k - i + 1])].split(b"\n")
                    lines += [own[w] for w in wanted[k]]
                ids = [blake2b(line, digest_size=16).digest() for line in lines]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(lines, pa.binary())], names=names)

    return docs.select("text", "wanted").mapInArrow(run, MEMBER_SCHEMA)


def removed_lines(docs: DataFrame, scratch: Scratch, least: int = LEAST_CHARS, percent: int = PERCENT, size: int = SHINGLE, short: bool = True) -> DataFrame:
    """(doc_id, tie, gone: line numbers from 0) of the documents (doc_id, tie, text) that lose lines.

    Rows that agree in doc_id and tie have the same text.
    """
    wide = scratch.cut(_signed(docs, least, size, percent, short), "lines")
    lines = wide.select("doc_id", "tie", "line_no", "id")
    # 48 bits name a line where tiles are found; lines that agree in them but not in all 128 both come along.
    short = F.xxhash64("id").bitwiseAND(F.lit(NAME_MASK))
    name = short.alias("name")
    shared = shared_tiles(wide.select(short.bitwiseOR(F.col("sizes").cast("long")).alias("name"), "keys"), scratch, percent)
    reps = lines.groupBy("id").agg(F.min(F.struct("doc_id", "tie", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = scratch.cut(reps, "reps")
    own = reps.select("first.*", name).join(shared.select("name").distinct().hint("shuffle_hash"), "name", "left_semi")
    own = scratch.cut(own.groupBy("doc_id", "tie").agg(F.collect_list("line_no").alias("wanted")), "wanted")
    members = scratch.cut(_members(docs.join(own.hint("shuffle_hash"), ["doc_id", "tie"]).select("text", "wanted")), "members")
    near = link_small_sets(shared, members.select("id", "elements", name), percent, scratch, bags_of=partial(line_bags, size=size))
    scratch.drop(members, shared, own)
    # A line of one copy that is linked with none has nothing to lose.
    joined = reps.join(near.hint("shuffle_hash"), "id", "left").filter("component is not null or copies > 1").withColumn("component", F.coalesce("component", "id"))
    joined = scratch.cut(joined.select("id", "first", "component"), "joined")
    best = joined.groupBy("component").agg(F.min("first").alias("winner"))
    losing = scratch.cut(joined.join(best.hint("shuffle_hash"), "component").select("id", "winner"), "losing")
    gone = lines.join(losing.hint("shuffle_hash"), "id").filter(F.struct("doc_id", "tie", "line_no") != F.col("winner"))
    gone = scratch.cut(gone.groupBy("doc_id", "tie").agg(F.collect_set("line_no").alias("gone")), "gone")
    scratch.drop(wide, reps, near, joined, losing)
    return gone


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS, percent: int = PERCENT, size: int = SHINGLE, short: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of text, and columns n_lines and n_removed.

    Lines of ``least`` characters or more are repeated if ``percent`` of their shingles of ``size``
    characters are the same; shorter ones that have a letter or digit if they are equal (not at all
    without ``short``); blank lines and rules such as ``---`` stay.  Letter case of A-Z and kinds of white space make no difference.
    The line that stays is the first by (doc_id, hash of the text, line number); a null doc_id comes
    first.  A null or empty text stays and has no lines.  Rows that repeat a (doc_id, text) are one
    document and lose the same lines.  Other columns pass through whatever their names; columns of
    docs named n_lines or n_removed are replaced.  An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in others]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows without doc_id are told apart from all others by the hash.
    rows = rows.withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull())).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    texts = rows.select("doc_id", "tie", "text")
    single = texts.filter("text is not null").dropDuplicates(["doc_id", "tie"]) if _repeats(texts) else texts
    gone = removed_lines(single, scratch, least, percent, size, short)
    out = rows.join(gone.hint("shuffle_hash"), ["doc_id", "tie"], "left")
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    cols = {c: F.col("row").getField(c) if c in others else None for c in docs.columns}
    cols["text"] = F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest)
    cols["n_lines"] = F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit(0)).otherwise(F.size(lines)).cast("long")
    cols["n_removed"] = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return out.select(*[v.alias(k) for k, v in cols.items()])


def _repeats(texts: DataFrame) -> bool:
    """Does any (doc_id, tie) stand in several rows?  Texts are read only if a doc_id does."""
    several = lambda *keys: bool(texts.groupBy(*keys).count().filter("count > 1").limit(1).count())
    return several("doc_id") and several("doc_id", "tie")
