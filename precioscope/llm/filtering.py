"""Op 12: codes of vectors by the filtering form of Lloyd's rounds.

Each task builds, once, kd-trees over the parts of its vectors, chunk by chunk, with the sum and the
count of every node.  In a round the codebook entries that a node's bounding box rules out are not
passed on; a node left with one entry gives its whole subtree to it.  All of it is whole numbers, so
the result does not depend on how the vectors are partitioned.  Chunks of trees are rows of a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from precioscope.llm.scratch import Scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
FACTOR = 256.0
LEAF = 16
CHUNK_ROWS = 4096
CHUNK_BYTES = 4 << 20
LIMB = 40


def kept_vectors(vectors: DataFrame, factor: float = FACTOR) -> DataFrame:
    """(vec_id, label, cells): floor(factor * x) as whole doubles; vectors that are null or hold null or
    non-finite components (also after the factor) take no part.  Without a label column labels are null."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * factor) != float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    return vectors.filter(ok).select("vec_id", label, F.transform(x, lambda v: v * factor).alias("cells"))


def tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, int]:
    """(order, depth): the points' order along a complete kd-tree whose segments halve at each level,
    each along its widest side."""
    n = len(points)
    depth = max(0, int(np.log2(max(1, n // leaf)))) if points.dtype != object and points.shape[1] else 0
    order = np.arange(n)
    for level in range(depth):
        bounds = segments(n, level)
        now = points[order]
        side = (np.maximum.reduceat(now, bounds[:-1]) - np.minimum.reduceat(now, bounds[:-1])).argmax(1)
        segment = np.repeat(np.arange(len(side)), np.diff(bounds))
        order = order[np.lexsort((now[np.arange(n), side[segment]], segment))]
    return order, depth


def segments(n: int, level: int) -> np.ndarray:
    """Bounds of the 2**level segments of n points; those of one level refine those of the one above."""
    bounds = np.array([0, n])
    for _ in range(level):
        middle = (bounds[:-1] + bounds[1:]) // 2
        bounds = np.concatenate([np.stack([bounds[:-1], middle], 1).ravel(), bounds[-1:]])
    return bounds


def _summed(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level (lo, hi, sum, count) of its nodes; levels above the leaves are made of their children."""
    bounds = segments(len(points), depth)
    at = bounds[:-1]
    levels = [(np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), np.add.reduceat(points, at), np.diff(bounds))]
    for _ in range(depth):
        lo, hi, total, count = levels[0]
        levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), total[::2] + total[1::2], count[::2] + count[1::2]))
    return levels


def assign(points: np.ndarray, depth: int, entries: np.ndarray, levels=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, sums, counts by entry): the nearest entry, of equally near ones the first.

    ``points`` lie in their tree's order.  An entry z is dropped at a node if the best entry b is nearer
    at every point of the box; that holds if it does at the box's corner furthest in the direction z - b.
    """
    k, n, kind = len(entries), len(points), points.dtype
    levels = levels or _summed(points, depth)
    code, sums, counts = np.zeros(n, np.int64), np.zeros((k, points.shape[1]), kind), np.zeros(k, np.int64)
    nodes, alive, index = np.zeros(1, np.int64), np.ones((1, k), bool), np.arange(k)
    for level in range(depth + 1):
        lo, hi, total, count = (x[nodes] for x in levels[level])
        gap = ((2 * entries[None] - (lo + hi)[:, None]) ** 2).sum(2)
        best = np.where(alive, gap, gap.max() + 1).argmin(1)
        b = entries[best][:, None]
        corner = np.where(entries[None] > b, hi[:, None], lo[:, None])
        further = ((entries[None] - b) * (entries[None] + b - 2 * corner)).sum(2)
        alive &= ~((further > 0) | ((further == 0) & (index[None] > best[:, None])))
        alive[np.arange(len(nodes)), best] = True
        one = alive.sum(1) == 1
        bounds = segments(n, level)
        for i in np.flatnonzero(one):
            code[bounds[nodes[i]] : bounds[nodes[i] + 1]] = best[i]
            sums[best[i]] += total[i]
            counts[best[i]] += count[i]
        nodes, alive = nodes[~one], alive[~one]
        if level < depth:
            nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(alive, 2, 0)
    if len(nodes):
        bounds = segments(n, depth)
        sizes = bounds[nodes + 1] - bounds[nodes]
        rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in nodes])
        gap = ((points[rows][:, None] - entries[None]) ** 2).sum(2)
        code[rows] = np.where(np.repeat(alive, sizes, 0), gap, gap.max() + 1).argmin(1)
        np.add.at(sums, code[rows], points[rows])
        counts += np.bincount(code[rows], minlength=k)
    return code, sums, counts


def _typed(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longs where squared distances stay below 2**62, else whole numbers of any size."""
    most = max(int(abs(points).max(initial=0)), int(abs(entries).max(initial=0)), 1)
    if max(1, points.shape[1]) * (4 * most) ** 2 < 1 << 62:
        return points.astype(np.int64), entries.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(points).astype(object).reshape(points.shape), entries.astype(object)


def _trees(kept: DataFrame, width: int, parts: int, scratch: Scratch) -> DataFrame:
    """Rows of trees: ids and labels of a chunk, and for each part its points in tree order, with that order."""
    types = {f.name: f.dataType.simpleString() for f in kept.schema}

    def packed(ids: list, labels: list, cells: list) -> pa.RecordBatch:
        points = np.concatenate(cells).reshape(sum(map(len, ids)), parts, width // parts)
        small = bool(abs(points).max(initial=0) < 1 << 31)
        orders, depths, stored = [], [], []
        for p in range(parts):
            x = points[:, p].astype(np.int64 if small else np.float64)
            order, depth = tree(x) if small else (np.arange(len(x)), 0)
            orders.append(order.astype(np.int32))
            depths.append(depth)
            stored.append(x[order].astype(np.int32 if small else np.float64))
        one = lambda v, t: pa.array([v], t)
        i, l = pa.concat_arrays(ids), pa.concat_arrays(labels)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (i, l)]
        return pa.RecordBatch.from_arrays([*lists, one(small, pa.bool_()), one(depths[0], pa.int32()), one(np.stack(orders).tobytes(), pa.binary()), one(np.stack(stored).tobytes(), pa.binary())], names=["ids", "labels", "small", "depth", "orders", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(LEAF, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(1, width))))
        ids, labels, cells, n = [], [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                lengths = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                flat = np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False))
                dense = np.zeros((part.num_rows, width))
                dense[np.arange(width)[None] < lengths[:, None]] = flat
                ids.append(part.column(0))
                labels.append(part.column(1))
                cells.append(dense.ravel())
                n += part.num_rows
                if n >= most:
                    yield packed(ids, labels, cells)
                    ids, labels, cells, n = [], [], [], 0
        if n:
            yield packed(ids, labels, cells)

    return scratch.cut(kept.select("vec_id", "label", "cells").mapInArrow(run, f"ids array<{types['vec_id']}>, labels array<{types['label']}>, small boolean, depth int, orders binary, points binary"), "trees")


def _read(batch: pa.RecordBatch, i: int, parts: int, w: int) -> tuple[np.ndarray, np.ndarray, int]:
    small, depth, orders, points = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("small", "depth", "orders", "points"))
    orders = np.frombuffer(orders, np.int32).reshape(parts, -1)
    return orders, np.frombuffer(points, np.int32 if small else np.float64).reshape(parts, orders.shape[1], w), depth


def _limbs(v: int) -> list[int]:
    """v in digits of LIMB bits, the last of them signed."""
    out = []
    while not -(1 << LIMB) < v < 1 << LIMB:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _round(trees: DataFrame, books: list[np.ndarray], parts: int, w: int) -> list[np.ndarray]:
    """The codebooks after one round; sums travel in limbs, so they are exact at any size.

    A task gives one row a part, entry, position and limb; the driver gets as many, summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros((len(b), w), object), np.zeros(len(b), np.int64)] for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                _, points, depth = _read(batch, i, parts, w)
                for p in range(parts):
                    x, book = _typed(points[p], books[p])
                    _, sums, counts = assign(x, depth, book)
                    total[p][0] += sums
                    total[p][1] += counts
        rows = []
        for p, (sums, counts) in enumerate(total):
            for e in np.flatnonzero(counts).tolist():
                rows.append((p, e, -1, 0, int(counts[e])))
                rows += [(p, e, d, limb, x) for d, v in enumerate(sums[e]) for limb, x in enumerate(_limbs(int(v)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=["part", "entry", "position", "limb", "value"])

    found = trees.mapInArrow(run, "part long, entry long, position long, limb long, value long").groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value"))
    sums: dict[tuple[int, int, int], int] = {}
    for r in found.toLocalIterator():
        key = (r["part"], r["entry"], r["position"])
        sums[key] = sums.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
    out = []
    for p, book in enumerate(books):
        new = book.copy()
        for e in range(len(book)):
            if count := sums.get((p, e, -1)):
                for d in range(w):
                    new[e, d] = sums[p, e, d] // count
        out.append(new)
    return out


def _codes(trees: DataFrame, books: list[np.ndarray], parts: int, w: int, types: dict[str, str]) -> DataFrame:
    top = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                orders, points, depth = _read(batch, i, parts, w)
                n = orders.shape[1]
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, object)
                for p in range(parts):
                    x, book = _typed(points[p], books[p])
                    code, _, _ = assign(x, depth, book)
                    codes[orders[p], p] = code
                    error[orders[p]] += ((x - book[code]) ** 2).sum(1)
                text = codes.tobytes().hex()
                step = 2 * parts
                ids, labels = (batch.column(batch.schema.get_field_index(c))[i].values for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([text[k * step : (k + 1) * step] for k in range(n)]), pa.array([min(int(v), top) for v in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector.

    Vectors that are null or hold null or non-finite components are dropped.  Shorter ones are filled with zeros to
    the greatest length, and that to a multiple of ``parts``.  The first codebook is made of the vectors
    of the ``entries`` smallest vec_ids (of equal ids the smaller vector; null ids only after all
    others), or of all if there are fewer.  Repeated rows each count and each have a row.  Errors past a
    long are held to its greatest value.  An empty table gives no row.
    """
    if entries > 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    spark, kept = vectors.sparkSession, kept_vectors(vectors)
    scratch = Scratch(spark, "codes")
    longest = kept.agg(F.max(F.size("cells"))).first()[0] or 0
    width = -(-longest // parts) * parts
    w, types = width // parts, {f.name: f.dataType.simpleString() for f in kept.schema}
    first: list[Row] = kept.orderBy(F.col("vec_id").asc_nulls_last(), "cells").limit(entries).collect()  # at most ``entries`` rows
    start = np.array([[int(np.floor(v)) for v in r["cells"]] + [0] * (width - len(r["cells"])) for r in first], object).reshape(len(first), parts, w)
    books = [start[:, p].copy() for p in range(parts)]
    trees = _trees(kept, width, parts, scratch)
    for _ in range(rounds if first else 0):
        books = _round(trees, books, parts, w)
    said = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    codes = scratch.cut(_codes(trees, books, parts, w, types), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
