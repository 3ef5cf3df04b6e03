"""Op 13: ranked lexical search by TPUT over term-partitioned postings.

The three-phase uniform threshold method for the best documents of many queries: list heads give each
query a lower bound of its k-th score; every list then gives the entries that reach an equal share of
it, which no document of the answer can do without; what is still missing of the candidates that can
reach the k-th score is looked up.  Scores are whole numbers, so all bounds are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.llm import arrowtext as at
from precioscope.llm.scratch import Scratch

TOP = 20
#: Terms that one reading of the documents looks for, which bounds what is sent to the tasks; more terms take more readings.
SLICE = 1 << 17
#: Entries of one part of a list.
LIST_ROWS = 1 << 16
#: Terms of items that one pass over the lists adds up, and rows of a look-up that are sent to all tasks; more items take
#: more passes, longer look-ups a shuffle.
NEED_ROWS = 1 << 17
SENT_ROWS = 1 << 17
#: Hits and sums that a task holds at a time.
HITS = 1 << 21
#: Bytes that are in no term: ASCII without letters and digits.
BREAK = np.zeros(256, bool)
BREAK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms_of(text: str) -> dict[str, int]:
    """Terms of one text with their counts."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = at.spans(data, np.array([0, len(data)]), BREAK)
    low, found = _LOWER[data].tobytes(), {}
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        term = low[a:b].decode()
        found[term] = found.get(term, 0) + 1
    return found


def item_terms(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item_id, iid, term, times): the terms of each item; rows that repeat an item are one item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _terms_of(batch.column(2)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(k)[i].as_py()] * len(found), batch.schema.field(k).type) for k in (0, 1)] + [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["item_id", "iid", "term", "times"])

    once = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    once = scratch.cut(once.select("item_id", F.monotonically_increasing_id().alias("iid"), "text"), "items")
    return scratch.cut(once.mapInArrow(run, f"item_id {kind}, iid long, term string, times long"), "asked")


def _matcher(terms: list[str]):
    """A function of (bytes, starts, ends) to the number of the term in each span or -1; bytes are compared."""
    stored = b"".join(t.encode() for t in terms)
    data = np.frombuffer(stored, np.uint8)
    ends = np.cumsum([len(t.encode()) for t in terms], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    hashes = at.hash_spans(data, starts, ends, lower=True)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]

    def match(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = at.hash_spans(text, start, end, lower=True)
        out = np.full(len(h), -1, np.int64)
        place = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        left = np.flatnonzero(ranked[place] == h)
        place = place[left]
        while len(left):  # once, but where terms of the vocabulary share a hash
            number, length = order[place], (end - start)[left]
            same = (ends - starts)[number] == length
            l, m, size = left[same], number[same], length[same]
            if len(l):
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                equal = _LOWER[text[np.repeat(start[l], size) + step]] == data[np.repeat(starts[m], size) + step]
                good = np.logical_and.reduceat(equal, np.cumsum(size) - size)
                out[l[good]] = m[good]
            more = (out[left] < 0) & (place + 1 < len(ranked))
            more[more] = ranked[place[more] + 1] == h[left[more]]
            left, place = left[more], place[more] + 1
        return out

    return match


def _postings(docs: DataFrame, terms: list[str], first: int) -> DataFrame:
    """(term, uid, doc_id, tf, n): listed terms of each document with their number and its length, and one
    row of term -1, alone with the doc_id, of each document that has terms."""
    kind, match = docs.schema["doc_id"].dataType.simpleString(), _matcher(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in at.chunked(batch.column(2)):
                start, end, doc = at.spans(data, offsets, BREAK)
                n = np.bincount(doc, minlength=j - i)
                number = match(data, start, end)
                pair, tf = np.unique(doc[number >= 0] * len(terms) + number[number >= 0], return_counts=True)
                row, term, full = pair // len(terms), first + pair % len(terms), np.flatnonzero(n)
                own = pa.array(np.concatenate([i + row, i + full]))
                named = pa.array(np.concatenate([i + row, i + full]), mask=np.arange(len(row) + len(full)) < len(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(term, np.full(len(full), -1))), batch.column(0).take(own), batch.column(1).take(named), pa.array(np.append(tf, np.zeros(len(full), np.int64))), pa.array(n[np.concatenate([row, full])])], names=["term", "uid", "doc_id", "tf", "n"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"term long, uid long, doc_id {kind}, tf long, n long")


def _lists(docs: DataFrame, asked: DataFrame, scratch: Scratch, slice_: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The impact lists (term, uid, impact) of all asked terms, (name, term) of these, and (uid, doc_id).

    Lists are dealt out by term, those of more than LIST_ROWS entries in several parts.
    """
    spark = docs.sparkSession
    vocabulary = scratch.cut(asked.select("term").distinct(), "vocabulary")
    slices = max(1, -(-vocabulary.count() // slice_))
    lists, names, ids = None, None, None
    for s in range(slices):
        terms = sorted(r["term"] for r in vocabulary.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == s).collect())  # about SLICE
        if not terms:
            continue
        raw = scratch.cut(_postings(docs, terms, s << 32), "postings", dictionary=True)
        if ids is None:
            ids = scratch.cut(raw.filter("term = -1").select("uid", "doc_id", "n"), "documents")
            total = ids.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
            N, L = total["docs"], max(total["words"] or 0, 1)
        df = raw.filter("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(N) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
        weighed = df.select("term", weight.alias("w"), F.ceil(F.col("df") / LIST_ROWS).cast("long").alias("lots"))
        m = F.expr(f"100 - 25 + ((25 * n * {N}L) div {L}L)")
        entries = raw.filter("term >= 0").join(F.broadcast(weighed), "term").withColumn("m", m)  # a row a term of the slice
        impact = entries.select("term", "uid", F.expr("w * ((1000000000 * tf) div (1000 * tf + 12 * m))").alias("impact"), "lots").filter("impact > 0")
        dealt = impact.repartition("term", F.pmod(F.xxhash64("uid"), F.col("lots"))).drop("lots").sortWithinPartitions("term", F.col("impact").desc())
        own = scratch.cut(dealt, "lists", dictionary=True)
        scratch.drop(raw)
        named = spark.createDataFrame([(t, (s << 32) + i) for i, t in enumerate(terms)], "name string, term long")
        lists, names = (own, named) if lists is None else (lists.unionByName(own), names.unionByName(named))
    return None if lists is None else (lists, names, ids)


def _summed(reach: DataFrame, need: list, k: int) -> DataFrame:
    """(iid, uid, score, upper): what the entries (term, uid, impact) of each document, which lie together,
    give each item, and what it can reach at most; only where that is no less than the k-th best so far.

    ``need`` is a block of items: rows of iid, term, times, least, rest, bound.
    """
    items = np.array(sorted({r["iid"] for r in need}), np.int64)
    rows = sorted(need, key=lambda r: r["term"])
    terms, first = np.unique(np.array([r["term"] for r in rows], np.int64), return_index=True)
    ends = np.append(first[1:], len(rows))
    column = np.searchsorted(items, [r["iid"] for r in rows])
    least, times, rest = (np.array([r[c] for r in rows], np.int64) for c in ("least", "times", "rest"))
    floor_, open_ = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    floor_[column] = [r["bound"] for r in rows]
    np.add.at(open_, column, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, bound = np.zeros((k, len(items)), np.int64), floor_.copy()

        def some(doc: np.ndarray, uids: np.ndarray, t: np.ndarray, impact: np.ndarray) -> pa.RecordBatch:
            nonlocal best, bound
            many = ends[t] - first[t]
            spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first[t], many)
            value = np.repeat(impact, many)
            hit = value >= least[spot]
            spot, value, at_ = spot[hit], value[hit], np.repeat(doc, many)[hit]
            cell = at_ * len(items) + column[spot]
            score, found = np.zeros(len(uids) * len(items), np.int64), np.zeros(len(uids) * len(items), np.int64)
            np.add.at(score, cell, value * times[spot])
            np.add.at(found, cell, rest[spot])
            score = score.reshape(len(uids), len(items))
            best = np.partition(np.vstack([best, score]), len(uids), axis=0)[len(uids) :]
            np.maximum(bound, best.min(0), out=bound)
            upper = score + open_ - found.reshape(score.shape)
            d, i = np.nonzero((score > 0) & (upper >= bound))
            return pa.RecordBatch.from_arrays([pa.array(items[i]), pa.array(uids[d]), pa.array(score[d, i]), pa.array(upper[d, i])], names=["iid", "uid", "score", "upper"])

        def whole(uid: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[pa.RecordBatch]:
            place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
            asked = terms[place] == term
            uid, t, impact = uid[asked], place[asked], impact[asked]
            start = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else np.zeros(0, int)
            hits = np.add.reduceat(ends[t] - first[t], start) if len(uid) else start
            edges, a, most = np.append(start, len(uid)), 0, max(1, HITS // len(items))
            while a < len(start):  # runs of documents whose hits and sums are bounded
                b = a + max(1, min(most, int(np.searchsorted(np.cumsum(hits[a : a + most]), HITS, "right"))))
                b = min(b, len(start))
                lo, hi = edges[a], edges[b]
                yield some(np.repeat(np.arange(b - a), np.diff(edges[a : b + 1])), uid[start[a:b]], t[lo:hi], impact[lo:hi])
                a = b

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last document may go on
            yield from whole(*(c[:cut] for c in now))
            held = [c[cut:] for c in now]
        yield from whole(*held)

    return reach.select("uid", "term", "impact").repartition("uid").sortWithinPartitions("uid").mapInArrow(run, "iid long, uid long, score long, upper long")


def _best(scores: DataFrame, k: int, *order) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("iid").orderBy(*order))).filter(F.col("rank") <= k)


def _bound(scores: DataFrame, k: int) -> DataFrame:
    """(iid, bound): the k-th highest score, 0 where there are fewer."""
    return _best(scores, k, F.col("score").desc()).groupBy("iid").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(0)).alias("bound"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, slice_: int = SLICE, need_rows: int = NEED_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item by the whole-number score.

    Of equal scores the smaller doc_id comes first, null last.  Null and empty texts have no terms: as a
    document they are not counted, as an item they have no row.  Every row of documents is a document, rows that
    repeat one too; rows that repeat an item are one item.  Terms that no document holds add
    nothing.  Other columns do not matter; an empty table on either side gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranks")
    asked = item_terms(items, scratch)
    found = _lists(docs, asked, scratch, slice_)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    lists, names, ids = found

    # 1: list heads.  The partial sums of k documents bound the k-th score from below.
    inside = Window.partitionBy("term").orderBy(F.col("impact").desc(), "uid")
    heads = scratch.cut(lists.withColumn("place", F.row_number().over(inside)).filter(F.col("place") <= k), "heads")
    known = heads.groupBy("term").agg(F.max("impact").alias("top"))
    need = asked.withColumnRenamed("term", "name").join(names, "name").join(known, "term").select("iid", "term", "times", "top")
    need = scratch.cut(need.join(need.groupBy("iid").agg(F.count(F.lit(1)).alias("width")), "iid"), "need")
    partial = heads.join(need.select("iid", "term", "times"), "term").groupBy("iid", "uid").agg(F.sum(F.col("impact") * F.col("times")).alias("score"))

    # 2: every list gives the entries that reach an equal share of the bound; they are added up by document.
    share = F.expr("greatest(1, (bound + width * times - 1) div (width * times))")
    need = need.join(_bound(partial, k), "iid").withColumn("least", share).withColumn("rest", F.least(F.col("least") - 1, "top") * F.col("times"))
    need = scratch.cut(need, "shares")
    blocks = max(1, -(-need.count() // need_rows))
    seen = None
    for b in range(blocks):
        block = need.filter(F.pmod(F.xxhash64("iid"), F.lit(blocks)) == b)
        rows = block.collect()  # about NEED_ROWS
        if not rows:
            continue
        lowest = block.groupBy("term").agg(F.min("least").alias("lowest"))
        own = scratch.cut(_summed(lists.join(F.broadcast(lowest), "term").filter("impact >= lowest"), rows, k), "seen")
        seen = own if seen is None else seen.unionByName(own)
    if seen is None:  # no term of the items is in any document
        seen = spark.createDataFrame([], "iid long, uid long, score long, upper long")

    # 3: what the candidates that can reach the k-th score still miss is looked up.
    able = scratch.cut(seen.join(_bound(seen.select("iid", "score"), k), "iid").filter("upper >= bound").drop("bound"), "candidates")
    wanted = able.filter("upper > score").select("iid", "uid").join(need.filter("rest > 0").select("iid", "term", "times", "least"), "iid")
    wanted = scratch.cut(wanted, "wanted")
    few = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted
    looked = lists.join(few, ["term", "uid"]).filter("impact < least").groupBy("iid", "uid").agg(F.sum(F.col("impact") * F.col("times")).alias("more"))
    exact = able.join(looked, ["iid", "uid"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0))).join(ids.select("uid", "doc_id"), "uid")
    best = _best(exact, k, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
    return best.join(asked.select("iid", "item_id").distinct(), "iid").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
