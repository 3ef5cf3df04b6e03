"""Op 10: exact n-gram Jaccard join of documents.

A document is its set of word shingles.  Equal sets are one representative.  A band holds sizes of a
ratio of at most 1 / t**2, so similar sets lie in the same or in neighbouring bands.  Each band cuts
the hash space into more parts than two similar sets of it can differ in elements: some part agrees
wholly, and the hash of its elements is the key of a tile.  There are spare parts for those that are
empty by chance, so these are keys of a few sets only.  Tiles compare members by parity bitmaps,
whose bit counts bound the overlap from above, then by exact sorted-array intersection (linking.py).
No shingle is a key by itself, so a passage that many documents share makes no large tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.llm.arrowtext import chunked, mix, word_shingles
from precioscope.llm.linking import bitmap_bits, link_large_sets, most_apart, parity_bitmap, shared_tiles
from precioscope.llm.scratch import Scratch

#: Parts beyond the least number: so many, and more in bands where sets have more empty parts by chance (spare_parts).
SPARE_PARTS = 3
SEEN_SETS = 100_000
_PART, _BAND, _SUM = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
SIGN_SCHEMA = "doc long, id binary, name long, n long, keys array<long>"
ELEMENT_SCHEMA = "name long, id binary, n long, bitmap binary, elements binary"


def bands(percent: int, most: int = 1 << 40) -> list[int]:
    """Ascending least sizes of the bands; smaller sets than the first are similar to equal ones only."""
    low = 1
    while most_apart(low, low + 1, percent) < 1:
        low += 1
    out = [low]
    while out[-1] < most:
        out.append(max(out[-1] + 2, out[-1] * 100 * 100 // (percent * percent)))
    return out


@cache
def spare_parts(apart: int, least: int) -> int:
    """Parts beyond ``apart`` + 1, so that sets of ``least`` elements hardly ever have more empty parts than that.

    Of two sets that agree in more parts than one of them has empty, some part that agrees is not empty, so
    only sets with more empty parts need keys of these.  Such keys are common: all of a band have them by chance.
    """
    for spare in range(SPARE_PARTS, SPARE_PARTS + apart // 2):
        parts = apart + 1 + spare
        load = least / parts
        none = math.exp(-load)
        if spare >= parts * none + 4 * math.sqrt(parts * none * (1 - (1 + load) * none)):
            return spare
    return SPARE_PARTS + apart // 2


def set_keys(u: np.ndarray, edges: list[int], percent: int) -> np.ndarray:
    """Tile keys of a sorted set of hashes."""
    n = len(u)
    if n < edges[0]:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(edges, n, "right")) - 1
    schemes = [own, own + 1] if 100 * n >= percent * edges[own + 1] else [own]
    out = []
    value = mix(u ^ _SUM)
    for band in schemes:
        apart = int(most_apart(edges[band + 1] - 1, edges[band + 1] - 1, percent))
        spare = spare_parts(apart, edges[band] * percent // 100)
        parts = apart + 1 + spare
        part = ((u >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        seed = np.uint64((band + 1) * int(_BAND) & (1 << 64) - 1)
        out.append(mix(np.add.reduceat(value, start) ^ mix(part[start] * _PART + seed)))
        if parts - len(start) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[start])
            out.append(mix(mix(empty * _PART + seed)))
    return np.concatenate(out)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        docs = batch.column(0).to_pylist()
        for i, j, offsets, data in chunked(batch.column(1)):
            hashes, bounds = word_shingles(data, offsets, words)
            for k in range(i, j):
                yield docs[k], np.unique(hashes[bounds[k - i] : bounds[k - i + 1]])


def _set_id(u: np.ndarray) -> bytes:
    return blake2b(u.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: its set's size, 128-bit hash and the first 64 bits of that as a name; once a task the
    set's tile keys."""

    kind = docs.schema["doc"].dataType.simpleString()
    doc_type = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SIGN_SCHEMA.split(", ")]
        kinds = (doc_type, pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        edges, seen = bands(percent), set()
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[c] for h in held], k) for c, k in enumerate(kinds)], names=names)

        for doc, u in _sets(batches, words):
            own = _set_id(u)
            keys = None
            if own not in seen and len(u):
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(own)
                keys = set_keys(u, edges, percent).view(np.int64)
                size += len(keys)
            held.append((doc, own, int.from_bytes(own[:8], "little", signed=True), len(u), keys))
            if len(held) >= 1000 or size > 200_000:
                yield out()
                held, size = [], 0
        yield out()

    return docs.select("doc", "text").mapInArrow(run, SIGN_SCHEMA.replace("doc long", f"doc {kind}"))


def _elements(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([h[c] for h in held], k) for c, k in enumerate(kinds)], names=[x.split()[0] for x in ELEMENT_SCHEMA.split(", ")])

        held: list[tuple] = []
        for _, u in _sets(batches, words):
            own = _set_id(u)
            held.append((int.from_bytes(own[:8], "little", signed=True), own, len(u), parity_bitmap(u, bitmap_bits(len(u), percent)), u.tobytes()))
            if len(held) >= 500:
                yield out()
                held = []
        yield out()

    return docs.select("doc", "text").mapInArrow(run, ELEMENT_SCHEMA)


def ngram_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, a number or binary, text; others are ignored).

    Two documents link when 100 * |meet| >= percent * |union| of their sets of ``words``-word
    shingles, A-Z lower-cased; fewer words are one shingle.  Null and empty texts and texts without
    words have no shingles and link with nothing.  component_id is the least doc_id that links
    reach.  Repeated rows have equal results; rows of one doc_id with different texts have a set
    and a component each, since members are named by their sets.  A null doc_id stays null and links
    with nothing.  An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    kind = "binary" if docs.schema["doc_id"].dataType.simpleString() == "binary" else "long"
    texts = docs.select(F.col("doc_id").cast(kind).alias("doc"), "text")
    known = texts.filter("doc is not null")
    wide = scratch.cut(signed(known, words, percent), "signs")
    signs = scratch.cut(wide.select("doc", "id", "name", "n"), "documents")
    shared = shared_tiles(wide.select("name", "keys"), scratch)
    scratch.drop(wide)  # keys need the most room
    sets = scratch.cut(signs.filter("n > 0").groupBy("id", "name").agg(F.min("doc").alias("rep")), "sets")
    wanted = sets.join(shared.select("name").distinct(), "name", "left_semi").select(F.col("rep").alias("doc")).distinct()
    arrays = _elements(known.join(wanted.hint("merge"), "doc", "left_semi"), words, percent)
    if signs.count() > signs.select("doc").distinct().count():  # a doc_id may bring a set twice
        arrays = arrays.dropDuplicates(["id"])
    arrays = scratch.cut(arrays, "arrays")
    near = link_large_sets(shared, arrays, percent, scratch)
    scratch.drop(arrays, shared)
    least = near.join(sets, "id").groupBy("component").agg(F.min("rep").alias("least"))
    linked = near.join(least, "component").select("id", "least")
    groups = sets.join(linked, "id", "left").select("id", F.coalesce("least", "rep").alias("least"))
    out = signs.join(groups, "id", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))
    lost = texts.filter("doc is null")
    blank = lost.select(F.col("doc").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc").alias("component_id"))
    return out.unionByName(blank)
