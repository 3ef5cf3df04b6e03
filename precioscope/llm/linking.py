"""Exact components of a set-similarity join, without a pair per link.

Members meet in tiles: keys that any two similar members share by construction (or with high
probability).  A tile gives its links as a spanning forest: members are compared by parity bitmaps,
whose bit counts bound the overlap from above, and the admitted pairs by exact sorted-array
intersection, except where both already are one component.  So a tile of n members gives at most
n - 1 links, however many pairs of it are similar, and yet every pair of a tile is either in one
component or decided.

A tile of many members is cut into blocks.  First each block links its own members; components grow
by distributed union-find.  Then only tiles with more than one component go on, and in these the
members of the largest component meet the others only, never each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.llm.arrowtext import mix
from precioscope.llm.components import components
from precioscope.llm.scratch import Scratch

BLOCK_MEMBERS = 256
SMALL_TILE = 6
#: A key of more than so many rows of a pack is hot; its rows need not meet to be known as shared.
LEAST_HOT = 64
PACK_ROWS = 1_000_000
PACKS, LEAST_PACKS = 16, 512
PACK_SCHEMA = "pack int, hot int, pairs binary"
_PLAIN, _HOT, _REST = range(3)
_FILL = np.uint64(np.iinfo(np.uint64).max)
_UNMARKED = np.uint64(np.iinfo(np.uint64).max - 1)
MET_ROWS = 1_000_000
#: A task that holds more than twice MET_ROWS gives away the rows of keys that have more than so many.
MET_KEY_ROWS = 20_000
SIZE_STEP = 1.065
NAME_MASK = ~0xFFFF
#: Of 16 bytes each, as are those of the hot keys of 8.
MOST_ASKED_SENT = 500_000
BATCH_ROWS = 50_000
ROWS_AT_ONCE = 4096
#: Whole tiles are compared together as far as they hold about so many bytes.
BYTES_AT_ONCE = 1 << 18
#: Pairs of tiles of at most so many members are compared many tiles at a time, by bitmaps of SPOTS bits.
PAIRED_TILE = 32
SPOTS = 2048
#: Elements of pairs that are put in order at a time: they stay in a core's cache.
PAIRED_ELEMENTS = 1 << 16


def parity_bitmap(hashes: np.ndarray, bits: int) -> bytes:
    """Bit i: is the number of hashes that equal i modulo ``bits`` (a power of 2) odd?"""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def bitmap_bits(n: int, percent: int) -> int:
    """Bits of the bitmap of a set of n elements: many times what two similar sets can differ in, so few others pass."""
    return min(1 << 16, max(64, 1 << int(32 * most_apart(n, n, percent)).bit_length()))


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of sets of n and m elements with 100 * meet >= percent * union."""
    return (100 - percent) * (n + m) // (100 + percent)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Is 100 * meet >= percent * union for two sorted sets?"""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    every = np.concatenate([x, y])
    every.sort()
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return 100 * both >= percent * (len(x) + len(y) - both)


def sorted_set(values: np.ndarray) -> np.ndarray:
    """The different values in order; for short arrays this is much faster than np.unique."""
    u = np.sort(values)
    again = u[1:] == u[:-1]
    return np.concatenate([u[:1], u[1:][~again]]) if again.any() else u


def size_bits(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """16 bits for the low end of a name: bounds of a set's size, in steps of SIZE_STEP."""
    step = lambda x: np.clip(np.floor(np.log(np.maximum(x, 1)) / np.log(SIZE_STEP)), 0, 255).astype(np.int64)
    return step(least) << 8 | step(most)


def _apart(name: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Are the sizes that two names tell too different for similar sets?"""
    low = lambda x: SIZE_STEP ** ((x >> 8) & 255).astype(float)
    high = lambda x: np.where(x & 255 == 255, np.inf, SIZE_STEP ** ((x & 255) + 1).astype(float))
    return (high(name) * 100 < percent * low(other)) | (high(other) * 100 < percent * low(name))


def _rows_of(key: np.ndarray, name: np.ndarray, raw: bool) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), BATCH_ROWS):
        k = key[i : i + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(name[i : i + BATCH_ROWS]), pa.array(np.full(len(k), raw))], names=["key", "name", "raw"])


def _packed(batches: Iterator[pa.RecordBatch], packs: int, most: int = PACK_ROWS) -> Iterator[pa.RecordBatch]:
    """(pack, hot, pairs) of the (name, keys) of a partition: keys and names of a range of keys in one row.

    Of a hot key one row goes to its pack and tells so, and the rest, known to be shared, is dealt to any pack.
    """
    parts: list[tuple] = []
    held = 0

    def out() -> pa.RecordBatch:
        key, name = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(key)
        key, name = key[order], name[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        kind = np.full(len(key), _PLAIN)
        if (hot := length > LEAST_HOT).any():
            kind[np.repeat(hot, length)] = _REST
            kind[start[hot]] = _HOT
        rows = []
        for k in (_PLAIN, _HOT, _REST):
            own, names = (key, name) if k == _PLAIN and not hot.any() else (key[kind == k], name[kind == k])
            if k == _REST:
                cuts = np.arange(0, len(own), LEAST_HOT)
                to = (mix(own[cuts] + cuts.astype(np.uint64)) % np.uint64(packs)).tolist()
            else:
                place = ((own >> np.uint64(32)) * np.uint64(packs)) >> np.uint64(32)
                cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(own) else np.zeros(0, np.int64)
                to = place[cuts].tolist()
            ends = [*cuts.tolist(), len(own)]
            rows += [(p, k, own[a:b].tobytes() + names[a:b].tobytes()) for p, a, b in zip(to, ends[:-1], ends[1:], strict=True)]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["pack", "hot", "pairs"])

    for batch in batches:
        keys = batch.column(1)
        key = keys.flatten().to_numpy().view(np.uint64)
        if not len(key):
            continue
        sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
        parts.append((key, np.repeat(pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False), sizes)))
        held += len(key)
        if held >= most:
            yield out()
            parts, held = [], 0
    if held:
        yield out()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name) of packed rows; of hot ones also (hot), one kind a batch."""
    for batch in batches:
        for kind, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            key, name = np.frombuffer(pairs, np.int64).reshape(2, -1)
            columns = {"key": pa.array(key), "name": pa.array(name)}
            if kind != _PLAIN:
                columns["hot"] = pa.array(np.full(len(key), kind))
            yield pa.RecordBatch.from_pydict(columns)


def _met(batches: Iterator[pa.RecordBatch], percent: int | None, most: int = 2 * MET_ROWS, large: int = MET_KEY_ROWS) -> Iterator[pa.RecordBatch]:
    """The (key, name, raw) of a partition whose key has several names, once each; with ``percent`` not those
    of two names whose sizes are too different.

    Rows of hot keys are given as they are (raw: names may repeat, and of one name only there may be).  Once more than
    ``most`` rows are held, keys of more than ``large`` of them are given away as they come, raw too, so what is held
    does not grow with a key.
    """
    parts, held, given, hot = [], 0, np.zeros(0, np.int64), []
    plain = (lambda n: n) if percent is None else (lambda n: n & NAME_MASK)
    for batch in batches:
        key, name = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
        if batch.num_columns > 2:
            yield from _rows_of(key, plain(name), True)
            if batch.column(2)[0].as_py() == _HOT:
                hot.append(key)
            continue
        if len(given):
            away = np.isin(key, given)
            yield from _rows_of(key[away], plain(name[away]), True)
            key, name = key[~away], name[~away]
        if len(key):
            parts.append((key, name))
            held += len(key)
        if held > most:
            key, name = (np.concatenate(c) for c in zip(*parts, strict=True))
            u, n = np.unique(key, return_counts=True)
            given = np.concatenate([given, u[n > large]])
            away = np.isin(key, given)
            yield from _rows_of(key[away], plain(name[away]), True)
            parts, held = [(key[~away], name[~away])], int((~away).sum())
            most = max(most, 2 * held)
    if not held:
        return
    key, name = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    if hot:
        away = np.isin(key, np.concatenate(hot))
        yield from _rows_of(key[away], plain(name[away]), True)
        key, name = key[~away], name[~away]
    order = np.argsort(key)
    key, name = key[order], name[order]
    # Most keys stand alone; only the rows of the others are put in order of names.
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    key, name = key[same], name[same]
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name = key[fresh], name[fresh]
    keep = np.zeros(len(key), bool)
    keep[1:] = key[1:] == key[:-1]
    pair = keep.copy()  # the second of a key's two names
    pair[1:] &= ~keep[:-1]
    pair[:-1] &= ~keep[1:]
    keep[:-1] |= keep[1:]
    if percent is not None:
        at = np.flatnonzero(pair)
        at = at[_apart(name[at - 1], name[at], percent)]
        keep[at] = keep[at - 1] = False
        name = name & NAME_MASK
    yield from _rows_of(key[keep], name[keep], False)


def _like(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, columns of ``table``, dropped when that is."""
    df.scratch_path = table.scratch_path
    return df


def shared_tiles(wide: DataFrame, scratch: Scratch, percent: int | None = None) -> DataFrame:
    """(key, name, count) of the keys that several names have; of keys with the same names, one.

    wide: (name long, keys array<long>), a table.  With ``percent`` the low 16 bits of a name are size_bits,
    which the result's names do not have any more.  Keys travel in packs, so a row moved holds many of them.
    """
    # Without the hot keys rows spread evenly, so a partition has about MET_ROWS rows of 16 bytes.
    total = wide.agg(F.sum(F.size("keys").cast("long")).alias("n")).first()["n"] or 0
    parts = total // MET_ROWS + 1
    packs = max(LEAST_PACKS, PACKS * parts)
    packed = wide.filter("keys is not null").select("name", "keys").mapInArrow(lambda batches: _packed(batches, packs), PACK_SCHEMA)
    met = packed.repartition(parts, "pack").mapInArrow(lambda batches: _met(_unpacked(batches), percent), "key long, name long, raw boolean")
    shared = scratch.cut(met, "tiles")
    if shared.filter("raw").limit(1).count():
        once = scratch.cut(shared.filter("not raw").unionByName(shared.filter("raw").distinct()), "once")
        scratch.drop(shared)
        shared = once
    shared = _like(shared.select("key", "name"), shared)
    marks = [F.bit_xor(F.xxhash64("name", F.lit(i))).alias(c) for i, c in enumerate("fg")]
    prints = shared.groupBy("key").agg(F.count(F.lit(1)).alias("count"), *marks).filter("count > 1")
    prints = prints.groupBy("count", "f", "g").agg(F.min("key").alias("key")).select("key", "count")
    out = scratch.cut(shared.join(prints, "key"), "kinds")
    scratch.drop(shared)
    return out


def forest(sets: list[np.ndarray], percent: int, labels: list | None = None) -> list[tuple[int, int]]:
    """Links that join what the pairwise links of ``sets`` join, members of one label being joined already.

    They are stars: each member that was joined here is linked to the first of its component.
    """
    n = len(sets)
    parent = list(range(n))
    if labels is not None:
        first: dict = {}
        parent = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined = []

    def compare(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y and similar(sets[a], sets[b], percent):
            parent[max(x, y)] = min(x, y)
            joined.append(max(x, y))

    if n <= SMALL_TILE:
        for a in range(n):
            for b in range(a):
                compare(a, b)
        return [(find(x), x) for x in joined]
    sizes = np.array([len(s) for s in sets])
    bits = bitmap_bits(int(np.median(sizes)), percent)
    spot = np.concatenate(sets) & np.uint64(bits - 1)
    odd = np.bincount(np.repeat(np.arange(n), sizes) * bits + spot.astype(np.int64), minlength=n * bits) & 1
    grid = np.packbits(odd.astype(bool), bitorder="little").view(np.uint64).reshape(n, bits // 64)
    root = np.array([find(i) for i in range(n)])
    found = []
    for i0 in range(0, n, 64):
        r = np.arange(i0, min(i0 + 64, n))
        c = np.arange(r[-1] + 1)
        apart = np.zeros((len(r), len(c)), np.int64)
        for w in range(grid.shape[1]):
            apart += np.bitwise_count(grid[r, w][:, None] ^ grid[c, w][None, :])
        np.maximum(apart, np.abs(sizes[r][:, None] - sizes[c][None, :]), out=apart)
        ok = (apart <= most_apart(sizes[r][:, None], sizes[c][None, :], percent)) & (c[None, :] < r[:, None]) & (root[r][:, None] != root[c][None, :])
        x, y = np.nonzero(ok)
        found.append((r[x], c[y], apart[x, y]))
    a, b, d = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.argsort(d, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        compare(i, j)
    return [(find(x), x) for x in joined]


def _pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (later, earlier) pairs of the members of tiles, given by first member and number of members."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[size > 1]).tolist():
        x, y = np.tril_indices(n, -1)
        at = start[size == n][:, None]
        a.append((at + x).ravel())
        b.append((at + y).ravel())
    return np.concatenate(a), np.concatenate(b)


def tile_forests(tiles: list[int] | np.ndarray, comps: list, bags: tuple[np.ndarray, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (stars) that join what the pairwise links inside each tile join; members of one label are joined already.

    tiles in order; bags: (elements one member after another, repeats allowed; number of each member's).  A bit that only
    one of two members sets stands for an element that only it has, so bit counts bound how far two are apart.
    """
    values, counts = bags
    n = len(tiles)
    ends = np.cumsum(counts)
    first: dict = {}
    parent = [i if c is None else first.setdefault((t, c), i) for i, (t, c) in enumerate(zip(tiles, comps, strict=True))]
    number = np.array(tiles)
    start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    size = np.diff(np.append(start, n))
    out = []
    for s, m in zip(start[size > PAIRED_TILE].tolist(), size[size > PAIRED_TILE].tolist(), strict=True):
        own = [i if comps[i] is None else comps[i] for i in range(s, s + m)]
        sets = [sorted_set(values[ends[i] - counts[i] : ends[i]]) for i in range(s, s + m)]
        out += [(s + x, s + y) for x, y in forest(sets, percent, own)]
    small = size <= PAIRED_TILE
    a, b = _pairs(start[small], size[small])
    if not len(a):
        return out
    present = np.zeros(n * SPOTS, bool)
    present[np.repeat(np.arange(n) * SPOTS, counts) + (values & np.uint64(SPOTS - 1)).astype(np.int64)] = True
    grid = np.packbits(present, bitorder="little").view(np.uint64).reshape(n, SPOTS // 64)
    apart = np.concatenate([np.bitwise_count(grid[a[i : i + ROWS_AT_ONCE]] ^ grid[b[i : i + ROWS_AT_ONCE]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), ROWS_AT_ONCE)])
    ok = np.flatnonzero(apart <= most_apart(counts[a], counts[b], percent))
    ok = ok[np.argsort(apart[ok], kind="stable")]
    a, b = a[ok], b[ok]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined = []
    best = 1
    while True:
        root = np.array(parent)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[a], root[b]
        a, b, x, y = (c[x != y] for c in (a, b, x, y))
        if not len(a):
            return out + [(find(x), x) for x in joined]
        # The closest pairs of each component; the others may need no look once these are joined.
        now = _among_first(np.stack([x, y], axis=1).ravel(), best).reshape(-1, 2).any(axis=1)
        near = _similar_pairs(a[now], b[now], values, ends - counts, counts, percent)
        for i, j in zip(a[now][near].tolist(), b[now][near].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                joined.append(max(x, y))
        a, b = a[~now], b[~now]
        best *= 2


def _among_first(x: np.ndarray, most: int) -> np.ndarray:
    """Is each value one of the first ``most`` of its kind?"""
    order = np.argsort(x, kind="stable")
    y = x[order]
    start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    out = np.empty(len(x), bool)
    out[order] = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x)))) < most
    return out


def _similar_pairs(a: np.ndarray, b: np.ndarray, values: np.ndarray, start: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """similar() of many pairs of bags, whose elements are told apart by their upper 63 bits.

    The elements of a pair are put in order in a row of a matrix, marked in the last bit by whose they are: a member's repeats
    are then equal neighbours, and neighbours that differ in the mark alone are one element of both.
    """
    out = np.zeros(len(a), bool)
    total = counts[a] + counts[b]
    order = np.argsort(total, kind="stable")
    a, b, total = a[order], b[order], total[order]
    plain = values & _UNMARKED
    marked = plain | np.uint64(1)
    i = 0
    while i < len(a):
        # Of nearly the same size, so little is filled up.
        least = int(total[i])
        j = min(int(np.searchsorted(total, max(least * 9 // 8, 64), "right")), i + max(1, PAIRED_ELEMENTS // (least + 1)))
        grid = np.full((j - i, int(total[j - 1]) + 1), _FILL)
        places = (start[a[i:j]], counts[a[i:j]], start[b[i:j]], counts[b[i:j]])
        for row, at, n, to, m in zip(grid, *(c.tolist() for c in places), strict=True):
            row[:n] = plain[at : at + n]
            row[n : n + m] = marked[to : to + m]
        grid.sort(axis=1)
        change = grid[:, 1:] ^ grid[:, :-1]
        # One change is that to what fills the row up, and one less than there are different elements.
        different = np.count_nonzero(change, axis=1)
        both = np.count_nonzero(change == 1, axis=1)
        out[order[i:j]] = 100 * both >= percent * (different - both)
        i = j
    return out


def _tile_links(members: DataFrame, percent: int, bags_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): the links of each tile's forest; members (tile, id, component, elements) sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tiles: np.ndarray, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            at = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]]))
            ends = np.append(np.cumsum(pc.fill_null(pc.binary_length(rows["elements"]), 0).to_numpy().astype(np.int64)), 0)
            cuts = at[np.flatnonzero(np.diff(ends[at - 1] // BYTES_AT_ONCE)) + 1] if len(at) > 1 else at[:0]
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tiles)], strict=True):
                own = rows.slice(i, j - i)
                ids, comps, elements = (own[c].combine_chunks() for c in ("id", "component", "elements"))
                links = np.array(tile_forests(tiles[i:j], comps.to_pylist(), bags_of(elements), percent), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(links[:, k])) for k in (0, 1)], names=["a", "b"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            tiles = rows["tile"].to_numpy()
            # The last tile may go on in the next batch.
            whole = int(np.searchsorted(tiles, tiles[-1])) if len(tiles) else 0
            if whole:
                yield from out(tiles[:whole], rows.slice(0, whole))
            rest = rows.slice(whole)
        if rest is not None and len(rest):
            yield from out(rest["tile"].to_numpy(), rest)

    return members.select("tile", "id", "component", "elements").mapInArrow(run, "a binary, b binary")


def bags(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets one after another, and the number of each one's elements."""
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)


def _home(shared: DataFrame) -> DataFrame:
    """(key, name, count) of each name's key with most members, counted by those whose key that is; not of one alone."""
    home = shared.groupBy("name").agg(F.max_by("key", F.struct("count", "key")).alias("key"))
    return home.join(home.groupBy("key").agg(F.count(F.lit(1)).alias("count")).filter("count > 1"), "key")


def _asked(ids: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, elements) of the members in ``ids``: only sets that are asked for move."""
    asked = scratch.cut(ids.distinct(), "asked")
    few = F.broadcast(asked) if asked.count() <= MOST_ASKED_SENT else asked
    return members.select("id", "elements").join(few, "id", "left_semi")


def _in_blocks(shared: DataFrame) -> DataFrame:
    """Rows (key, name, count) with tile: a block of their key."""
    block = F.pmod(F.xxhash64("name", "key"), F.ceil(F.col("count") / BLOCK_MEMBERS))
    return shared.withColumn("tile", F.when(F.col("count") > BLOCK_MEMBERS, F.xxhash64("key", block)).otherwise(F.col("key")))


def open_tiles(members: DataFrame) -> DataFrame:
    """Rows of the keys that hold several components, once per tile in which they have to meet others.

    members: (key, id, component, ...).  The largest component of a key and the others are cut into
    blocks apart: blocks of others meet each other and each block of the largest, so what is sent
    grows with the others, not with the square of the key's members.
    """
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("giant"), F.max("n").alias("own"), F.sum("n").alias("all")).filter("own < all")
    blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("long")
    keys = keys.select("key", "giant", blocks(F.col("own")).alias("giants"), blocks(F.col("all") - F.col("own")).alias("others"))
    rows = members.join(keys, "key").withColumn("in_giant", F.col("component") == F.col("giant"))
    own = F.pmod(F.xxhash64("id", "key"), F.when(F.col("in_giant"), F.col("giants")).otherwise(F.col("others")))
    rows = rows.withColumn("own", own)
    count = F.when(F.col("in_giant"), F.col("others")).otherwise(F.col("others") + F.col("giants"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    # Blocks of others are 0, 1, ...; those of the largest component come after them.
    place = F.when(F.col("in_giant"), F.col("others") + F.col("own")).otherwise(F.col("own"))
    tile = F.xxhash64("key", F.least(place, "other"), F.greatest(place, "other"))
    return rows.withColumn("tile", tile).drop("giant", "giants", "others", "in_giant", "own", "other")


def _sorted_by_tile(members: DataFrame) -> DataFrame:
    return members.repartition("tile").sortWithinPartitions("tile")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _no_component() -> F.Column:
    return F.lit(None).cast("binary").alias("component")


def _grown(links: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Labels (id, component) after further links (a, b)."""
    if labels is not None:
        links = links.unionByName(labels.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    out = scratch.cut(components(links, scratch), "labels")
    scratch.drop(labels)
    return out


def link_small_sets(shared: DataFrame, members: DataFrame, percent: int, scratch: Scratch, sets_of: Callable[[list[bytes]], list[np.ndarray]] | None = None, bags_of: Callable | None = None) -> DataFrame:
    """(id, component) of the members that are linked with another, where elements are short.

    Elements are read by ``sets_of``, or by ``bags_of`` (all elements of a column, repeats allowed, and the number of each member's).

    shared (key, name, count); members (name, id, elements), tables; several ids may share a name.
    Every tile is decided exactly where its members meet: blocks of keys first, then what is left
    between the blocks of large keys.
    """
    bags_of = bags_of or (lambda elements: bags(sets_of(elements.to_pylist())))
    # A name has few rows without elements, so they are hashed and the members need not be sorted.
    rows = _in_blocks(shared).hint("shuffle_hash").join(members, "name").select("tile", "id", _no_component(), "elements")
    links = scratch.cut(_tile_links(_sorted_by_tile(rows), percent, bags_of), "links")
    labels = _grown(links, None, scratch)
    large = shared.filter(F.col("count") > BLOCK_MEMBERS).join(members.select("name", "id"), "name").select("key", "id")
    rest = scratch.cut(open_tiles(_labelled(large, labels)), "open")
    if rest.limit(1).count():
        rows = rest.join(_asked(rest.select("id"), members, scratch), "id").select("tile", "id", "component", "elements")
        links = scratch.cut(_tile_links(_sorted_by_tile(rows), percent, bags_of), "links")
        labels = _grown(links, labels, scratch)
    scratch.drop(rest)
    return labels


def sorted_hashes(elements: bytes) -> np.ndarray:
    return np.frombuffer(elements, np.uint64)


def admitted(ids: list[bytes], comps: list[bytes], sizes: np.ndarray, bitmaps: list[bytes], percent: int, best: int, parent: dict | None = None) -> tuple[list[tuple[bytes, bytes]], bool]:
    """Pairs of different components that the bit counts admit, the ``best`` of each two components; more left?

    With ``parent``, a forest of components, only the closest pair of each two trees, which it joins.
    """
    least = min(map(len, bitmaps))
    grid = np.stack([_fold(np.frombuffer(b, np.uint64), least // 8) for b in bitmaps])
    number: dict = {}
    comp = np.array([number.setdefault(c, len(number)) for c in comps])
    found = []
    for i0 in range(0, len(ids), 64):
        r = np.arange(i0, min(i0 + 64, len(ids)))
        c = np.arange(r[-1] + 1)
        apart = np.zeros((len(r), len(c)), np.int64)
        for w in range(grid.shape[1]):
            apart += np.bitwise_count(grid[r, w][:, None] ^ grid[c, w][None, :])
        np.maximum(apart, np.abs(sizes[r][:, None] - sizes[c][None, :]), out=apart)
        ok = (apart <= most_apart(sizes[r][:, None], sizes[c][None, :], percent)) & (comp[r][:, None] != comp[c][None, :]) & (c[None, :] < r[:, None])
        x, y = np.nonzero(ok)
        found.append((r[x], c[y], apart[x, y]))
    a, b, d = (np.concatenate(z) for z in zip(*found, strict=True))
    if not len(a):
        return [], False
    low, high = np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])
    name = [int.from_bytes(i[:8], "little") for i in ids]
    order = np.lexsort((np.array(name, np.uint64)[a], d, high, low))
    a, b, both = a[order], b[order], low[order] * len(number) + high[order]
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    keep = np.arange(len(both)) - np.repeat(start, np.diff(np.append(start, len(both)))) < best
    if parent is not None:
        first, keep = start[np.argsort(d[order][start], kind="stable")], np.zeros(len(both), bool)
        for k in first.tolist():
            x, y = _root(parent, comps[a[k]]), _root(parent, comps[b[k]])
            if x != y:
                parent[x] = y
                keep[k] = True
    pairs = [(min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]
    return pairs, not keep.all()


def _root(parent: dict, x: bytes) -> bytes:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _candidates(members: DataFrame, percent: int, best: int) -> DataFrame:
    """(a, b, key): admitted pairs of sorted (tile, key, id, component, n, bitmap); of a tile that has more, a row of its key alone.

    With ``best`` 0 a task gives pairs that join its components as the admitted ones do (a forest), and no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bytes, tuple] = {}
        tile = None
        found: set[tuple[bytes, bytes]] = set()  # of this task; given and forgotten when it grows
        parent: dict[bytes, bytes] = {}
        more: set[int] = set()

        def take() -> None:
            if len(rows) > 1:
                _, keys, ids, comps, sizes, bitmaps = zip(*rows.values(), strict=True)
                pairs, rest = admitted(list(ids), list(comps), np.array(sizes), list(bitmaps), percent, best, None if best else parent)
                found.update(pairs)
                if rest:
                    more.add(keys[0])

        def out() -> pa.RecordBatch:
            given = [*((a, b, None) for a, b in found), *((None, None, k) for k in more)]
            kinds = (pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in given], kind) for k, kind in enumerate(kinds)], names=["a", "b", "key"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[0] != tile:
                    take()
                    rows, tile = {}, row[0]
                rows[row[2]] = row
            if len(found) + len(more) + len(parent) > 100_000:
                yield out()
                found.clear()
                more.clear()
                parent.clear()
        take()
        yield out()

    return members.select("tile", "key", "id", "component", "n", "bitmap").mapInArrow(run, "a binary, b binary, key long")


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b, linked) by exact intersection of the sorted element arrays; pairs is a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [similar(sorted_hashes(x), sorted_hashes(y), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    own = scratch.cut(_asked(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b"))), arrays, scratch), "own")
    x, y = own.select(F.col("id").alias("a"), F.col("elements").alias("x")), own.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, linked boolean")


def link_large_sets(shared: DataFrame, arrays: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of the members that are linked with another, where sets are large and share many tiles.

    shared (key, name, count); arrays (name, id, n, bitmap, elements), tables.  Members compare bitmaps,
    first in one tile each, the one with most members, then in all tiles between the components so far.
    At first a task gives pairs that would make a tree of its components, so a group of near copies gives
    as many pairs as it has members; then the best pair of each two components.  Pairs are verified by
    their elements, true links merge components, and rounds go on with the keys that have further admitted
    pairs until there is none: where all admitted pairs are given, nothing is left to decide.
    """
    names, meta = arrays.select("name", "id"), arrays.select("id", "n", "bitmap")
    rows = _in_blocks(_home(shared)).join(names, "name").withColumn("component", F.col("id"))
    found = scratch.cut(_candidates(_sorted_by_tile(rows.join(meta, "id")), percent, 0), "candidates")
    pairs = scratch.cut(found.filter("a is not null").select("a", "b"), "pairs")
    result = scratch.cut(_verified(pairs, arrays, percent, scratch), "verified")
    labels = _grown(result.filter("linked").select("a", "b"), None, scratch)
    checked, best = result.filter("not linked").select("a", "b"), 0
    now = scratch.cut(shared.select("key", "name").join(names, "name").select("key", "id"), "members")
    while True:
        tiles = scratch.cut(open_tiles(_labelled(now, labels)), "open")
        found = scratch.cut(_candidates(_sorted_by_tile(tiles.join(meta, "id")), percent, best), "candidates")
        pairs = found.filter("a is not null").select("a", "b").distinct().join(checked, ["a", "b"], "left_anti")
        pairs = scratch.cut(pairs, "pairs")
        result = scratch.cut(_verified(pairs, arrays, percent, scratch), "verified")
        linked = result.filter("linked").limit(1).count()
        more = found.filter("key is not null").select("key").distinct()
        some = more.limit(1).count()
        checked = checked.unionByName(result.filter("not linked").select("a", "b"))
        if linked:
            labels = _grown(result.filter("linked").select("a", "b"), labels, scratch)
        if not some:
            return labels
        old, now = now, scratch.cut(now.join(more, "key", "left_semi"), "members")
        scratch.drop(old, tiles, found)
        best = 1 if best == 0 else best if linked else 16 * best
