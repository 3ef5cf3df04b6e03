"""Op 11: shards by balanced label propagation.

Documents of one text (and of one hub, where the caller links more) pull each other into one shard.
Copies are first contracted to nodes, a large group to several pieces of bounded bytes, so neither a
node nor a join key grows with the hottest text.  A round sums each hub's weight by shard, joins the
sums back, lets every linked node ask for the shard that holds most of its neighbours, and grants
what the shards' byte quotas have room for, highest gain first.  Unlinked nodes follow at no cost and
fill the shards evenly at the end.  The driver sees histograms of a fixed number of cells only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.llm.scratch import Scratch

SHARDS = 8
#: A group of equal texts is one node up to this part of a shard, and so many pieces beyond it.
PIECES_PER_SHARD = 256
ROUNDS = 12
SETTLE_ROUNDS = 6
#: Shards count as even when none is further from the mean than this share of it.
EVEN = 0.0002
#: Part of a shard that the quotas add while labels spread, if all documents are linked; none if at most half are.
SLACK = 0.125
CELLS = 64
SLOT_ROWS = 1 << 14


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
    )


def _noded(rows: DataFrame, big: DataFrame) -> DataFrame:
    """The rows with their node, and the hub of pieces; ``big`` has at most shards * PIECES_PER_SHARD keys."""
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("uid"), F.col("pieces")))
    both = rows.join(F.broadcast(big), "key", "left")
    return both.withColumn("node", F.xxhash64("key", F.coalesce(piece, F.lit(0)))).withColumn("hub", F.when(F.col("pieces").isNotNull(), F.xxhash64("key"))).drop("pieces")


def _log2(x) -> F.Column:
    return F.floor(F.log2(F.greatest(x.cast("double"), F.lit(1.0)))).cast("int")


def _sizes(nodes: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: int(r["b"]) for r in nodes.groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}  # one row a shard
    return [found.get(s, 0) for s in range(shards)]


def _pulls(members: DataFrame, shards: int, open_: list[bool], round_: int) -> DataFrame:
    """(node, n, bytes, shard, target, gain, stay): what each linked node's neighbours weigh in its own
    shard and in the best one that is open; equal weights are settled by hub, so copies agree."""
    weight = F.col("n") * F.col("times")
    hubs = members.groupBy("hub").agg(*[F.sum(F.when(F.col("shard") == s, weight).otherwise(0)).alias(f"w{s}") for s in range(shards)])
    own = members.join(hubs, "hub")
    score = own.groupBy("node").agg(
        F.first("n").alias("n"), F.first("bytes").alias("bytes"), F.first("shard").alias("shard"), F.min("hub").alias("tie"),
        F.array(*[F.sum(F.col(f"w{s}") - F.when(F.col("shard") == s, weight).otherwise(0)) for s in range(shards)]).alias("w"),
    )
    # In turn only moves up or down a rotated order of shards, so two nodes never change places for ever.
    up = lambda s: F.pmod(s + round_ // 2, F.lit(shards))
    allowed = lambda s: F.array(*map(F.lit, open_))[s] & ((up(s) > up(F.col("shard"))) if round_ % 2 else (up(s) < up(F.col("shard"))))
    ranked = F.transform("w", lambda w, s: F.struct(F.when(allowed(s), w).otherwise(F.lit(-1)).alias("w"), (-F.pmod(F.col("tie") + s, F.lit(shards))).alias("t"), s.alias("s")))
    best = score.withColumn("best", F.array_max(ranked)).withColumn("stay", F.element_at("w", F.col("shard") + 1))
    return best.select("node", "n", "bytes", "shard", F.col("best.s").cast("int").alias("target"), (F.col("best.w") - F.col("stay")).alias("gain"), "stay")


def _granted(asked: DataFrame, used: list[int], capacity: int, round_: int, shards: int) -> tuple[F.Column, bool]:
    """A condition that grants the highest gains a byte until each shard's room is used; ``used`` follows."""
    level, cell = _log2(1 + F.col("gain").cast("double") * 2**20 / F.col("bytes")), F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(CELLS)).cast("int")
    place = (level * CELLS + (CELLS - 1 - cell)).alias("place")
    table = asked.groupBy("target", place, "shard").agg(F.sum("bytes").alias("b")).collect()  # shards * shards * levels * CELLS at most
    wanted: dict[tuple[int, int], dict[int, int]] = {}
    for r in table:
        wanted.setdefault((r["target"], r["place"]), {})[r["shard"]] = int(r["b"])
    least, waiting = [1 << 30] * shards, [sorted((at for t, at in wanted if t == s), reverse=True) for s in range(shards)]
    moved = True
    while moved:  # what leaves a shard makes room in it; lower gains do not overtake
        moved = False
        for to in range(shards):
            while waiting[to] and used[to] + sum(wanted[to, waiting[to][0]].values()) <= capacity:
                least[to] = waiting[to].pop(0)
                for source, b in wanted[to, least[to]].items():
                    used[source] -= b
                    used[to] += b
                moved = True
    return place >= F.array(*map(F.lit, least))[F.col("target")], any(x < 1 << 30 for x in least)


def propagate(members: DataFrame, total: int, shards: int, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Labels of ``members`` (node, hub, times, n, bytes, shard) after rounds of label propagation."""
    used, quiet = _sizes(members.select("node", "bytes", "shard").distinct(), shards), 0
    # Where nearly all is linked, shards must be overfull for a while or nothing could move.
    capacity = int(-(-total // shards) * (1 + SLACK * max(0.0, 2 * sum(used) / total - 1)))
    for r in range(rounds):
        open_ = [capacity - u >= max(1, capacity // (2 * PIECES_PER_SHARD)) for u in used]
        if not any(open_) or quiet == 2:
            break
        asked = scratch.cut(_pulls(members, shards, open_, r).filter("gain > 0"), "asked")
        grant, some = _granted(asked, used, capacity, r, shards)
        quiet = 0 if some else quiet + 1
        if some:
            moved = asked.filter(grant).select("node", "target")
            now = scratch.cut(members.join(moved, "node", "left").withColumn("shard", F.coalesce("target", "shard")).drop("target"), "members")
            scratch.drop(members)
            members = now
        scratch.drop(asked)
    return members


def settle(nodes: DataFrame, total: int, shards: int, scratch: Scratch, rounds: int = SETTLE_ROUNDS, even: float = EVEN) -> DataFrame:
    """``nodes`` (node, bytes, shard, stay) with shards made even: cells of nodes with the least pull leave
    the shards above the mean for those below it, large nodes first."""
    spare = [total / shards - u for u in _sizes(nodes, shards)]
    for r in range(rounds):
        if max(map(abs, spare)) <= max(even * total / shards, 1):
            break
        over = [s for s in range(shards) if spare[s] < 0]
        loss, width = F.when(F.col("stay") > 0, 1 + _log2(F.col("stay"))).otherwise(0), _log2(F.col("bytes"))
        cell = F.pmod(F.xxhash64("node", F.lit(1000 + r)), F.lit(CELLS)).cast("int")
        named = nodes.withColumns({"loss": loss, "width": width, "cell": cell})
        where = ["shard", "loss", "width", "cell"]
        table = named.filter(F.col("shard").isin(over)).groupBy(*where).agg(F.sum("bytes").alias("b")).collect()  # shards * 64 * 64 * CELLS cells at most
        plan = []
        for x in sorted(table, key=lambda x: (x["loss"], -x["width"], x["cell"], x["shard"])):
            to = max(range(shards), key=lambda s: spare[s])
            # A cell also moves where it overshoots, as long as the two shards end nearer to the mean.
            if (max(abs(spare[x["shard"]] + x["b"]), abs(spare[to] - x["b"]))) < max(abs(spare[x["shard"]]), abs(spare[to])) and spare[x["shard"]] < 0:
                spare[x["shard"]] += x["b"]
                spare[to] -= x["b"]
                plan.append((x["shard"], x["loss"], x["width"], x["cell"], to))
        if not plan:
            break
        moves = nodes.sparkSession.createDataFrame(plan, "shard int, loss int, width int, cell int, target int")
        now = scratch.cut(named.join(F.broadcast(moves), where, "left").withColumn("shard", F.coalesce("target", "shard")).select(*nodes.columns), "settled")
        scratch.drop(nodes)
        nodes = now
    return nodes


def _slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Gapless numbers within each shard: counts of bounded buckets give offsets, rows are numbered in buckets."""
    buckets = max(1, rows // (shards * SLOT_ROWS))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("uid"))
    return placed.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + inside - 1)


def shard_documents(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row of ``docs`` in one of the shards.

    The law is ``bytes``: sizes (UTF-8 bytes and 1) of the shards are near equal, as near as whole nodes
    allow.  Rows of one text are neighbours; ``links`` (doc_id, hub) makes rows of one hub neighbours too.
    A null text is the empty text; rows that repeat a doc_id or a whole row each have a slot; a null
    doc_id is kept and linked by its text only; other columns do not matter; an empty table gives no row.  ``grown_shard``
    belongs to another law and is null.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.cut(_rows(docs), "rows")
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    piece = max(1, total // (shards * PIECES_PER_SHARD))
    groups = rows.groupBy("key").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).filter((F.col("b") > piece) & (F.col("c") > 1))
    big = scratch.cut(groups.select("key", F.least("c", F.ceil(F.col("b") / piece)).cast("long").alias("pieces")), "big")
    noded = _noded(rows, big)
    nodes = scratch.cut(noded.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.first("hub").alias("hub")).withColumn("shard", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(shards)).cast("int")), "nodes")
    ties = nodes.filter("hub is not null").select("node", "hub", F.lit(1).cast("long").alias("times"))
    if links is not None:
        named = links.select("doc_id", F.xxhash64(F.col("hub").cast("string"), F.lit("hub")).alias("hub")).filter("doc_id is not null").join(noded.select("doc_id", "node"), "doc_id")
        ties = ties.unionByName(named.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times")))
    members = scratch.cut(ties.join(nodes.select("node", "n", "bytes", "shard"), "node"), "members")
    if members.limit(1).count():
        members = propagate(members, total, shards, scratch, rounds)
        final = _pulls(members, shards, [False] * shards, 0).select("node", F.col("shard").alias("to"), "stay")
        joined = nodes.join(final, "node", "left").select("node", "bytes", F.coalesce("to", "shard").alias("shard"), F.coalesce("stay", F.lit(0)).alias("stay"))
        even = scratch.cut(joined, "labels")
    else:
        even = nodes.select("node", "bytes", "shard", F.lit(0).cast("long").alias("stay"))
    even = settle(even, total, shards, scratch)
    placed = scratch.cut(noded.join(even.select("node", "shard"), "node").select("doc_id", "size", "text_crc32", "uid", "shard"), "placed")
    return _slots(placed, count, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
