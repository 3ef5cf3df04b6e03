"""Tiles, their forests and the components of links."""

from __future__ import annotations

import numpy as np


def test_a_small_chain_takes_no_star_rounds(spark):
    from precioscope.llm.components import components
    from precioscope.llm.scratch import Scratch

    scratch = Scratch(spark, "chain")
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(16)
    got = {r["id"]: r["component"] for r in components(edges, scratch).collect()}
    assert got == dict.fromkeys(range(301), 0)
    assert scratch.n == 1


def test_forests_of_many_tiles_join_what_pairs_join():
    from precioscope.llm.linking import bags, similar, tile_forests

    rng = np.random.default_rng(5)
    tiles, comps, sets = [], [], []
    for tile, n in enumerate([1, 2, 3, 5, 9, 20, 32, 33, 60]):
        centres = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(3)]
        for i in range(n):
            own = np.concatenate([centres[i % 3][int(rng.integers(0, 9)) :], rng.integers(0, 1 << 63, 2).astype(np.uint64)])
            tiles.append(tile)
            comps.append([None, b"x", b"y"][i % 4 % 3] if tile % 2 else None)
            sets.append(np.unique(own))

    def parts(links):
        up = list(range(len(sets)))
        first = {}
        links = [*links, *((first.setdefault((t, c), i), i) for i, (t, c) in enumerate(zip(tiles, comps, strict=True)) if c is not None)]
        for _ in range(len(sets)):
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if tiles[a] == tiles[b] and similar(sets[a], sets[b], 80)]
    values, counts = bags([np.concatenate([s, s[:5]]) for s in sets])  # repeats make no difference
    links = tile_forests(tiles, comps, (values, counts), 80)
    assert parts(links) == parts(pairs) and len(links) < len(sets)


def test_lines_are_those_that_splitting_gives():
    import pyarrow as pa

    from precioscope.llm.linededup import _signed

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    line = "a line of more than twenty characters ção"
    texts = [None, "", "\n", f"{line}\n", line, f"\n\n{line} 1\nshort\n---\n\n{line} 2", "x", f"{line}\n{line} 3\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "tie", "text"])
    got = [(r["doc_id"], r["line_no"]) for b in _signed(Docs(), 20, 5, 80, True)(iter([batch])) for r in b.to_pylist()]
    want = [(i, k) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if any(map(str.isalnum, x))]
    assert got == want


def test_hot_keys_travel_in_packs_without_a_join(spark):
    from precioscope.llm.linking import LEAST_HOT, shared_tiles
    from precioscope.llm.scratch import Scratch

    hot = 5 * LEAST_HOT
    rows = [(i, [7, 1000 + i, 2000 + i // 2]) for i in range(hot)] + [(9000, [1001]), (9001, None), (9002, [-5, 8]), (9003, [-5]), (0, [7, 1000])]
    wide = spark.createDataFrame(rows, "name long, keys array<long>").repartition(3)
    got: dict = {}
    for r in shared_tiles(wide, Scratch(spark, "hot")).collect():
        got.setdefault(r["key"], []).append((r["name"], r["count"]))
    want = {7: range(hot), 1001: (1, 9000), -5: (9002, 9003), **{2000 + i: (2 * i, 2 * i + 1) for i in range(hot // 2)}}
    assert {k: sorted(v) for k, v in got.items()} == {k: [(n, len(v)) for n in v] for k, v in want.items()}


def test_near_misses_are_mostly_no_candidates():
    from precioscope.llm.linking import admitted, bitmap_bits, most_apart, parity_bitmap

    rng = np.random.default_rng(9)
    n, few = 600, 0
    over = int(most_apart(n, n, 85) * 1.08) // 2 + 1
    for _ in range(50):
        u = rng.integers(0, 1 << 63, n + over).astype(np.uint64)
        maps = [parity_bitmap(s, bitmap_bits(n, 85)) for s in (u[:n], u[over:])]
        few += len(admitted([b"a" * 16, b"b" * 16], [b"a", b"b"], np.array([n, n]), maps, 85, 1)[0])
    assert few < 10


def test_pairs_of_small_tiles_are_compared_together(monkeypatch):
    """no pair of a small tile is compared alone, and what is decided is what single comparisons decide."""
    from precioscope.llm import linking

    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(1)
    sets, tiles = [], []
    for tile in range(300):
        centre = draw(int(rng.integers(1, 400)))
        for _ in range(2 + tile % 4):
            gone = int(len(centre) * rng.uniform(0, 0.25))
            own = np.concatenate([centre[gone:], draw(int(gone * rng.uniform(0, 0.5)))])
            sets.append(np.concatenate([own, own[: int(rng.integers(0, 3))]]))
            tiles.append(tile)
    values, counts = linking.bags(sets)
    a, b = linking._pairs(*(np.array(x) for x in (np.searchsorted(tiles, range(300)), np.bincount(tiles))))
    want = [linking.similar(np.unique(sets[x]), np.unique(sets[y]), 80) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert linking._similar_pairs(a, b, values, np.cumsum(counts) - counts, counts, 80).tolist() == want
    assert 0.2 < np.mean(want) < 0.8

    def alone(*_):
        raise AssertionError("a pair was compared alone")

    monkeypatch.setattr(linking, "similar", alone)
    assert linking.tile_forests(tiles, [None] * len(tiles), (values, counts), 80)


def test_tiles_go_on_in_the_next_batch(monkeypatch):
    import pyarrow as pa

    from precioscope.llm import linking
    from precioscope.llm.linededup import line_bags

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    lines = [b"a line of more than twenty characters, number %d" % (k // 10) for k in range(400)]
    rows = {"tile": [k // 7 - 9 for k in range(400)], "id": [b"%03d" % k for k in range(400)], "component": pa.nulls(400, pa.binary()), "elements": lines}
    whole = pa.RecordBatch.from_pydict(rows)
    run = linking._tile_links(Rows(), 80, line_bags)
    links = lambda batches: sorted((r["a"], r["b"]) for out in run(iter(batches)) for r in out.to_pylist())
    want = links([whole])
    assert want == sorted((b"%03d" % (k // 7 * 7), b"%03d" % k) for k in range(400) if k % 7)
    monkeypatch.setattr(linking, "BYTES_AT_ONCE", 300)
    for step in (1, 3, 50):
        assert links([whole.slice(0, 0), *(whole.slice(k, step) for k in range(0, 400, step))]) == want
    assert links([]) == links([whole.slice(0, 0)]) == []
