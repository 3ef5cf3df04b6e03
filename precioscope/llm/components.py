"""Distributed union-find: connected components of an edge table.

Rounds of the two-phase star contraction (large star, small star): every node's neighbours are
re-pointed to the least one, by a map-side minimum and a join that Spark can split at hot nodes.
Edges stay in shared-folder tables; the driver sees only counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.llm.scratch import Scratch

#: A small table is not worth rounds of shuffles; a task's union-find of so many edges takes some 60 MB.
EDGES = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v.  Large: each node's greater neighbours point to its least neighbour or
    itself; small: each node's lesser neighbours and itself point to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return edges.join(least, edges["v"] == least["node"]).select("u", F.col("m").alias("v")).distinct()
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    out = edges.join(least, edges["u"] == least["node"])
    return out.select("u", F.col("m").alias("v")).unionByName(out.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside a partition: its edges become stars around least nodes."""
    parent: dict = {}
    kind: pa.DataType | None = None

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(x, find(x)) for x in parent]
    rows = [r for r in rows if r[0] != r[1]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every node that an edge (a, b) touches; component is its least node.

    Nodes are of any type that has an order.
    Tasks of at most about EDGES edges first contract their own; star rounds join what is left between
    them, and there are none where one task held all.  ``edges`` is a table, read twice.  Loops and repeated edges do not matter; no
    edges give no rows.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # Contracted where the edges are: dealing them out by a node would bring a hub's to one task.
    now = scratch.cut(pairs.coalesce(edges.count() // EDGES + 1).mapInArrow(_local, f"u {kind}, v {kind}").distinct(), "edges")
    while True:
        # Done when it is a forest of stars: no centre has a lesser neighbour and no leaf two.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        bad = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter("leaf > 1 or (leaf > 0 and centre > 0)")
        if not bad.limit(1).count():
            break
        new = scratch.cut(_star(_star(now, True), False), "stars")
        scratch.drop(now)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
