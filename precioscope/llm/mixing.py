"""Op 9: mixing sources to target weights.

Every source's words are packed into fixed-length blocks by distributed prefix sums (the source is
split into hashed buckets, more for larger sources, so one that holds a third of all rows is spread
like the others).  Output shards are the unit of the mix: a multinomial draw gives the number of
slots that each shard takes from each source, the source's slots are numbered shard by shard from
these counts, a slot is mapped to a block by the source's own pseudorandom permutation of block
indexes (a Feistel network, one per pass over the source), and slots are joined to blocks by index.
The draws of a source add up to the slots that its target needs and its last slot is cut to the words
still due, so the words taken meet the target to the word.  The mixed rows are put out by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
#: Shards that one draw of counts takes; more are drawn for groups of so many first.
DRAW_SHARDS = 4096
BUCKET_WORDS = 20_000_000
LEAST_BUCKETS = 64
SEED = 20240601
RUN_SLOTS = 1 << 16
COUNT_SCHEMA = "source_no long, source string, source_size long, due long, shard long, first long, n long"
SLOT_SCHEMA = "source_no long, shard long, slot long, pass_no int, block long, words long"


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_no, weight, source_size, target.

    Sources by code point, null last, take the weights in turn and share the total of all sizes.
    A target stops at ``most`` times its source's size and what exceeds it is shared by weight among
    the rest until none is above: in order of size over weight the stopped sources are a prefix, so
    running sums over the (one row a source) table find the level exactly.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("source_no", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = every.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    onward = every.orderBy("ratio", "source_no").rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # Not stopped: its cap is at least its share of what the stopped before it leave.
    per = per.withColumn("open_level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_no", "level"))).over(every)["level"])
    stopped = F.col("open_level").isNull() | (F.col("ratio") < F.col("open_level"))
    return per.withColumn("target", F.when(stopped, F.col("cap")).otherwise(F.col("weight") * F.col("open_level"))).select("source", "source_no", "weight", "source_size", "target")


def word_offsets(sized: DataFrame, sources: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Documents with source_no, source_size, target and first: words of their source before them.

    Within a source the order is (hashed bucket, doc_id, text hash), the same at every run.
    """
    docs = sized.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    buckets = F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.col("source_size") / bucket_words).cast("long"))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), buckets))
    per = docs.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(per, ["source_no", "bucket"]).withColumn("first", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


def permute(index: np.ndarray, n: int, key: list[int], inverse: bool = False) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of range(n): Feistel with cycle walking."""
    if n <= 1:
        return index.copy()
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rounds = np.random.SeedSequence(key).generate_state(4, np.uint64)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> half, out[todo] & mask
        if inverse:
            left, right = right, left
        for k in rounds[::-1] if inverse else rounds:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(33)) & mask)
        if inverse:
            left, right = right, left
        out[todo] = (left << half) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def _name_key(name: str | None, seed: int) -> list[int]:
    return [seed, 0 if name is None else 1, *(name or "").encode("utf-8", "surrogatepass")]


def slots_needed(size: int, due: int, key: list[int], block_words: int) -> int:
    """How many slots give ``due`` words of a source: those of whole passes and the first of the last one."""
    n = -(-size // block_words)
    passes, left = divmod(due, size)
    if not left:
        return passes * n
    short = int(permute(np.array([n - 1]), n, [*key, passes], inverse=True)[0])
    last = -(-left // block_words)
    return passes * n + (last if short >= last else -(-(left + n * block_words - size) // block_words))


def _drawn(slots: int, shards: int, key: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first shard, counts) of groups of shards: one multinomial draw, made by groups where shards are many."""
    rng, starts = np.random.default_rng(key), range(0, shards, DRAW_SHARDS)
    sizes = np.array([min(DRAW_SHARDS, shards - a) for a in starts])
    due = rng.multinomial(slots, sizes / shards) if len(sizes) > 1 else [slots]
    for a, n, own in zip(starts, sizes, due, strict=True):
        yield a, rng.multinomial(own, np.full(n, 1 / n))


def draw_counts(sources: DataFrame, shards: int, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(source_no, source, source_size, due, shard, first, n): the slots first .. first + n - 1 of a source
    belong to the shard.

    How many of the slots that a source needs a shard gets is a multinomial draw, by a seed of the
    source, so reruns agree and sources need not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNT_SCHEMA.split(", ")]
        for batch in batches:
            for no, name, size, due in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = _name_key(name, seed)
                at = 0
                for low, drawn in _drawn(slots_needed(size, due, key, block_words), shards, key):
                    first = at + np.cumsum(drawn) - drawn
                    at += int(drawn.sum())
                    shard = np.flatnonzero(drawn)
                    own = [np.full(len(shard), no), pa.array([name] * len(shard), pa.string()), np.full(len(shard), size), np.full(len(shard), due), low + shard, first[shard], drawn[shard]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=names)

    due = F.round("target").cast("long")
    needs = sources.select("source_no", "source", "source_size", due.alias("due")).filter("due > 0 and source_size > 0")
    return needs.repartition("source_no").mapInArrow(run, COUNT_SCHEMA)


def draw_slots(counts: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Slots of the mix: (source_no, shard, slot, pass_no, block, words), from the shards' counts.

    Pass p maps its i-th slot to block permutation_p(i), so no block is taken twice in a pass and,
    targets being at most 3 W, none more than 3 times.  Runs of slots are made independently: only
    the last block of a source is short, and the inverse permutation tells where it comes.
    """

    def part(size: int, due: int, key: list[int], slot: int, end: int) -> tuple[np.ndarray, ...]:
        """(slot, pass, block, words) of the slots slot .. end - 1, all of one pass, as far as words are due."""
        n = -(-size // block_words)
        p, i = divmod(slot, n)
        left, missing = min(size, due - p * size), n * block_words - size
        short = int(permute(np.array([n - 1]), n, [*key, p], inverse=True)[0])
        before = i * block_words - (missing if short < i else 0)
        index = np.arange(i, i + end - slot, dtype=np.int64)
        block = permute(index, n, [*key, p])
        words = np.minimum(block_words, size - block * block_words)
        words = np.minimum(words, left - before - np.cumsum(words) + words)
        use = words > 0
        return p * n + index[use], np.full(int(use.sum()), p, np.int32), block[use], words[use]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SLOT_SCHEMA.split(", ")]
        for batch in batches:
            for no, name, size, due, shard, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, blocks, key = first, -(-size // block_words), _name_key(name, seed)
                while at < first + n:
                    end = min(first + n, at + RUN_SLOTS, (at // blocks + 1) * blocks)
                    slot, p, block, words = part(size, due, key, at, end)
                    cols = (np.full(len(slot), no), np.full(len(slot), shard), slot, p, block, words)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
                    at = end

    return counts.repartition("source_no", "shard").mapInArrow(run, SLOT_SCHEMA)


def segments(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, block, doc_id, tie, low, high): the words low..high - 1 of a block are this document's."""
    some = placed.filter("size > 0").select("source_no", "doc_id", "tie", "first", "size", F.explode(F.sequence(F.expr(f"first div {block_words}"), F.expr(f"(first + size - 1) div {block_words}"))).alias("block"))
    start = F.col("block") * block_words
    return some.select("source_no", "block", "doc_id", "tie", "first", F.greatest(F.col("first") - start, F.lit(0)).alias("low"), F.least(F.col("first") + F.col("size") - start, F.lit(block_words)).alias("high"))


class Mix:
    """Sources, placed documents, slots and their join by block index, each lazily usable."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int | None = None):
        scratch = Scratch(docs.sparkSession, "mix")
        sized = with_size(docs).withColumn("tie", F.xxhash64("text"))
        self.sized = scratch.cut(sized.select("doc_id", "source", "size", "tie"), "sized")
        self.sources = scratch.cut(source_targets(self.sized), "sources")
        self.placed = scratch.cut(word_offsets(self.sized, self.sources), "placed")
        total = self.sources.agg(F.sum("target")).first()[0] or 0
        self.shards = shards or int(max(1, total // (block_words * SHARD_SLOTS)))
        self.counts = scratch.cut(draw_counts(self.sources, self.shards, block_words, seed), "counts")
        # A table, so that its real size is known when the join is planned.
        self.slots = scratch.cut(draw_slots(self.counts, block_words, seed), "slots")
        # Of the document's words in the block, those before the slot's cut.
        self.taken = segments(self.placed, block_words).join(self.slots, ["source_no", "block"]).withColumn("take", F.least("high", "words") - F.col("low")).filter("take > 0")


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard of every document.

    ``docs`` has doc_id, text and source; other columns are ignored.  Null and empty texts have size
    0 and are taken 0 times; a null source is a source of its own; repeated rows keep one output row
    each and share their words evenly counted (equal rows cover different words of the stream).  If
    all texts are empty every target is 0; an empty table gives no row.  first_shard is the least
    output shard that takes words of the document, null if none does.
    """
    mix = Mix(docs, block_words, seed, shards)
    # A document of some words is told by where it begins in its source.
    per = mix.taken.groupBy(F.col("source_no").alias("_no"), F.col("first").alias("_first")).agg(F.sum("take").alias("taken"), F.min("shard").alias("first_shard"))
    p = mix.placed
    on = (F.col("source_no") == F.col("_no")) & (F.col("first") == F.col("_first")) & (F.col("size") > 0)
    return p.join(per, on, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The mixed corpus in the columns of ``docs``, put out by shard.

    Each pass over a source gives a document's taken words, in their order, in the least shard that
    takes some of them; a document taken whole keeps its text as it is, one taken in part keeps those
    runs of words joined by spaces.  Documents of which no word is taken are left out; rows of a
    document that is taken again share its doc_id.  Columns pass through whatever their names; an
    n_chars column is counted anew.  An empty table gives no row.
    """
    mix = Mix(docs, block_words, seed, shards)
    piece = mix.taken.select("source_no", "doc_id", "tie", "first", "pass_no", "shard", (F.col("block") * block_words + F.col("low") - F.col("first") + 1).cast("int").alias("at"), F.col("take").cast("int").alias("take"))
    runs = piece.groupBy("source_no", "doc_id", "tie", "first", "pass_no").agg(F.min("shard").alias("shard"), F.array_sort(F.collect_list(F.struct("at", "take"))).alias("runs"), F.sum("take").alias("n"))
    named = runs.join(mix.sources.select("source", "source_no"), "source_no")
    plain = [c for c in docs.columns if c not in ("text", "source")]
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in plain]).alias("row"), "doc_id", "source", "text", F.xxhash64("text").alias("tie"))
    if whole.groupBy("doc_id", "tie", "source").count().filter("count > 1").limit(1).count():
        whole = whole.dropDuplicates(["doc_id", "tie", "source"])
    left, right = whole.alias("w"), named.alias("r")
    on = F.col("w.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("w.tie") == F.col("r.tie")) & F.col("w.source").eqNullSafe(F.col("r.source"))
    out = left.join(right, on).select("w.row", "w.source", "w.text", "r.runs", "r.n", "r.shard")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    whole_text = F.col("n") == F.regexp_count("text", F.lit(WORD))
    cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(words, r["at"], r["take"]))), " ")
    out = out.repartition("shard") if mix.shards > 1 else out
    out = out.select("row", "source", F.when(whole_text, F.col("text")).otherwise(cut).alias("text"))
    cols = {c: F.col(c) if c in ("text", "source") else F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[v.alias(k) for k, v in cols.items()])
