"""Op 8: exact top-k search by tiled matrix products.

Vectors are packed into shards, stated queries into blocks; every (block, shard) tile is one matrix
product with a partial selection of its k best, and the per-tile lists are merged in a tree (groups
of shards first, then the query).  Ties go to the smaller id throughout.  No vector and no list is
gathered on the driver; only the number of shards is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.llm.scratch import Scratch

SHARD_ROWS = 2048
BLOCK_ROWS = 512
FAN = 8
PACK_SCHEMA = "part long, width int, ids binary, cells binary, top double"
LIST_SCHEMA = "query_id long, vec_id long, score long, part long"
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, factor: float = 1024.0) -> DataFrame:
    """(vec_id, cells): floor(factor * x) of each component as whole doubles.

    Vectors that are null or hold null or non-finite components take no part, nor rows without id.
    """
    x = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    cells = F.transform(x, lambda v: F.floor(v * factor).cast("double"))
    return vectors.filter(ok).select(F.col("vec_id").cast("long"), cells.alias("cells"))


def _pack(df: DataFrame, rows: int) -> DataFrame:
    """Vectors of a part and of equal width packed into rows of at most ``rows``; parts come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        now = None

        def out(key: tuple[int, int], pairs: list) -> pa.RecordBatch:
            pairs.sort(key=lambda p: p[0])
            cells = np.array([p[1] for p in pairs], np.float64).reshape(len(pairs), key[1])
            ids = np.array([p[0] for p in pairs], np.int64)
            top = float(np.abs(cells).max(initial=0.0))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()]), pa.array([cells.tobytes()]), pa.array([top])], names=["part", "width", "ids", "cells", "top"])

        for batch in batches:
            parts, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                cells = batch.column(2)[i].values.to_numpy(zero_copy_only=False)
                if parts[i] != now:
                    for key, pairs in held.items():
                        yield out(key, pairs)
                    held, now = {}, parts[i]
                own = held.setdefault((int(parts[i]), len(cells)), [])
                own.append((int(ids[i]), cells))
                if len(own) >= rows:
                    yield out((int(parts[i]), len(cells)), held.pop((int(parts[i]), len(cells))))
        for key, pairs in held.items():
            yield out(key, pairs)

    return df.sortWithinPartitions("part").mapInArrow(run, PACK_SCHEMA)


def tile_best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, bound: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best candidates of one tile; candidate ids ascend.

    Products are exact: by doubles where ``bound`` keeps every sum below 2**53, else by whole numbers
    of any size, held to the range of a long.
    """
    if bound < 2**53:
        scores = (q @ c.T).astype(np.int64)
    else:
        whole = np.array([[int(v) for v in r] for r in q], object).reshape(q.shape), np.array([[int(v) for v in r] for r in c], object).reshape(c.shape)
        scores = np.array([[max(-LONG, min(LONG, int(v))) for v in row] for row in whole[0].dot(whole[1].T)], np.int64).reshape(len(q), len(c))
    for i, query in enumerate(q_ids):
        s, ids = scores[i], c_ids
        if (own := ids == query).any():
            s, ids = s[~own], ids[~own]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            at = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
            s, ids = s[at], ids[at]
        yield query, ids, s


def _search(tiles: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, part, q_ids, q, q_top, c_ids, c, c_top = (batch.column(x)[i].as_py() for x in range(8))
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                q, c = (np.frombuffer(m, np.float64).reshape(n, width) for m, n in ((q, len(q_ids)), (c, len(c_ids))))
                found = list(tile_best(q_ids, q, c_ids, c, max(q_top, 1) * max(c_top, 1) * max(width, 1), k))
                sizes = [len(x[1]) for x in found]
                if not sum(sizes):
                    continue
                arrays = [np.repeat(np.array([x[0] for x in found], np.int64), sizes), np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]), np.full(sum(sizes), part, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["query_id", "vec_id", "score", "part"])

    return tiles.mapInArrow(run, LIST_SCHEMA)


def _keep_best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row.

    ``vectors`` has vec_id and embedding (other columns do not matter), ``is_query`` is a condition
    on vec_id.  Vectors of different lengths are not compared.  Repeated ids all take part as
    candidates and are asked once; a query without candidates gives no row; fewer than k candidates
    give all.  Scores past a long are held to its ends, as are components whose floor is.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    base = scratch.cut(scaled(vectors), "cells")
    total = base.count()
    shards = max(1, -(-total // shard_rows))
    groups = max(1, -(-shards // FAN))
    hashed = base.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    cands = _pack(hashed.repartition(-(-shards // FAN), "part").select("part", "vec_id", "cells"), shard_rows * 2)
    asked = base.filter(is_query).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // block_rows))
    queries = _pack(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(-(-blocks // FAN), "part").select("part", "vec_id", "cells"), block_rows * 2)
    # A block goes to every group of shards, not to every shard: the tile's shards come to it.
    spread = queries.select("width", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), F.col("top").alias("q_top"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    sides = cands.withColumn("group", (F.col("part") % groups).cast("int"))
    tiles = sides.join(spread, ["group", "width"]).select("width", "part", "q_ids", "q_cells", "q_top", "ids", "cells", "top")
    lists = _search(tiles, k)
    merged = _keep_best(lists.withColumn("branch", F.col("part") % groups), ["query_id", "branch"], k)
    return _keep_best(merged.drop("rank"), ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
