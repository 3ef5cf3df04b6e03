"""Op 2: tokens packed into sequences by bulk-synchronous best fit.

Documents are tokenized whole (each distinct word of a batch once) and cut into pieces.  Pieces of
equal length are interchangeable, and so are gaps of equal size, so both are sorted and matched as
runs: (size, first, count).  There are at most 4096 runs of pieces however many documents there are,
and a hot length is one run.  A round range-sorts the runs, sweeps every size range for successors
(the smallest gap that holds a piece) and the ranges' rests together, resolves conflicts by rank
inside the runs, updates the gaps and repeats.  The finished plan of runs is joined to the pieces by
(length, rank block); ranks come from salted counts, so no length is ranked by a single task.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.llm.arrowtext import chunked
from precioscope.llm.scratch import Scratch

CAPACITY = 4096
END_ID = 1
RANGES = 16
FITS = 4
RANK_BLOCK = 4096
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 64
#: Bounds of a task's memory: words and parts whose ids are kept, ids of all kept words, bytes of text at a time.
CACHE_WORDS = 300_000
CACHE_PARTS = 80_000
CACHE_IDS = 4_000_000
TEXT_BYTES = 4 << 20
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LOADED: dict[str, WordEncoder] = {}


_PLAIN = re.compile("[!-~\u00c0-\u00ff]*")
#: The word pattern of the lower-casing word BPE, here over the letters of _PLAIN.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_symbols() -> dict[int, str]:
    """Byte-level BPE's symbols of the characters of _PLAIN: printable Latin-1 bytes stand for themselves,
    the others, in order, for U+0100 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(symbol[b] for b in chr(c).encode()) for c in [*range(33, 127), *range(192, 256)]}


_SYMBOLS = _byte_symbols()


def _is_word_bpe(path: str) -> bool:
    """Is the file's normaliser and splitter the one that _PARTS stands for?"""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = (steps[0].get("pattern") or {}).get("Regex")
    return kinds == ["NFC", "Replace", "Lowercase"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [x.get("type") for x in steps] == ["Split", "ByteLevel"]


class WordEncoder:
    """Token ids of white-space separated words, each distinct word encoded once.

    This gives what encoding the whole text gives: the tokenizer's pattern never spans white space,
    and its normaliser works on neighbouring characters of a word only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer(self.tokenizer.model)
        self.parts: dict[str, list[int]] = {}
        self.plain = _is_word_bpe(path)
        self.words = pa.array([], pa.large_string())
        self.counts = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def load(path: str) -> WordEncoder:
        if path not in _LOADED:
            _LOADED[path] = WordEncoder(path)
        return _LOADED[path]

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words.  Words of printable ASCII and Latin-1 letters are split and mapped to
        byte symbols here (NFC leaves them as they are) and merged by the tokenizer's model; all others
        go through the whole tokenizer."""
        split: list = []
        for word in words.to_pylist():
            if not self.plain or not _PLAIN.fullmatch(word) or "<|" in word:
                split.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
            else:
                split.append(_PARTS.findall(word.lower()))
        fresh = list({p for parts in split if parts and parts[0].__class__ is str for p in parts if p not in self.parts})
        found = dict(zip(fresh, (e.ids for e in self.merger.encode_batch_fast([p.translate(_SYMBOLS) for p in fresh], add_special_tokens=False)), strict=True))
        if len(self.parts) < CACHE_PARTS:
            self.parts |= found
        known, lists = self.parts, []
        for parts in split:
            if not parts or parts[0].__class__ is int:
                lists.append(parts)
            elif len(parts) == 1:
                lists.append(found.get(parts[0]) or known[parts[0]])
            else:
                lists.append([i for p in parts for i in found.get(p) or known[p]])
        return np.fromiter(map(len, lists), np.int32, len(lists)), np.fromiter(itertools.chain.from_iterable(lists), np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        known = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(known))
        counts, ids = self._encode(fresh)
        place = known.to_numpy(zero_copy_only=False)
        miss = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
        at = np.where(miss, 0, place).astype(np.int64)
        at[miss] = len(self.words) + np.arange(int(miss.sum()))
        all_counts, all_ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        if len(all_counts) <= CACHE_WORDS and len(all_ids) <= CACHE_IDS:
            self.words, self.counts, self.ids = pa.concat_arrays([self.words, fresh]), all_counts, all_ids
        starts = np.cumsum(all_counts, dtype=np.int64) - all_counts
        word = at[codes]
        n = all_counts[word]
        ends = np.cumsum(n, dtype=np.int64)
        flat = all_ids[np.repeat(starts[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = np.concatenate([[0], ends])
        return flat, total[bounds[1:]] - total[bounds[:-1]]


    def documents(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Of each text its ids and the end id; a text of many times TEXT_BYTES is encoded run of words by run of words."""
        if len(texts) == 1 and texts.nbytes > 4 * TEXT_BYTES:
            words = pc.ascii_split_whitespace(texts).flatten()
            at, parts = 0, []
            ends = np.cumsum(pc.binary_length(words).to_numpy() + 1)
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES)))
                parts.append(self.encode(pa.array([" ".join(words.slice(at, to - at).to_pylist())], pa.large_string()))[0])
                at = to
            yield np.concatenate([*parts, [end_id]]).astype("<u4")
            return
        flat, counts = self.encode(texts)
        at = 0
        for n in counts.tolist():
            ids = np.empty(n + 1, "<u4")
            ids[:n], ids[n] = flat[at : at + n], end_id
            at += n
            yield ids


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.load(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).cast(pa.int64())
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), pa.scalar("", pa.large_string()))
            for i, j, _, _ in chunked(texts, TEXT_BYTES):
                rows = []
                for k, ids in enumerate(encoder.documents(texts.slice(i, j - i), end_id)):
                    n = len(ids) - 1
                    rows += [(k, p, s, min(capacity, n + 1 - s), zlib.crc32(ids[s : s + capacity])) for p, s in enumerate(range(0, n + 1, capacity))]
                cols = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


# Kinds of run rows: pieces still to place, gaps, and matches of the round (they are the plan).
PIECES, GAPS, MATCHES = 0, 1, 2
RUN_SCHEMA = "kind int, size long, first long, n long, bin long, bins long, copies long, offset long, fresh boolean"
RUN_COLUMNS = [x.split()[0] for x in RUN_SCHEMA.split(", ")]


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int) -> list[tuple]:
    """One successor sweep over ascending runs: every gap takes the largest waiting piece that it holds.

    Conflicts are resolved by rank: the i-th piece of a run goes to the i-th gap of the run.  A gap
    takes several copies where there are enough pieces for all gaps of its run.  Returns run rows.
    """
    out, waiting, k = [], [], 0
    pieces, gaps = sorted(pieces), sorted(gaps)
    for gap, bin_, bins in gaps:
        while k < len(pieces) and pieces[k][0] <= gap:
            waiting.append(list(pieces[k]))
            k += 1
        open_ = [(gap, bin_, bins, 0)]
        while open_:
            room, bin_, bins, fits = open_.pop()
            at = bisect.bisect_right(waiting, room, key=lambda x: x[0]) - 1
            if at < 0 or fits == FITS:
                out.append((GAPS, room, bin_, bins, 0, 0, 0, 0, fits > 0))
                continue
            size, first, n = waiting[at]
            use = min(n, bins)
            copies = max(1, min(room // size, n // use))
            out.append((MATCHES, size, first, use * copies, bin_, use, copies, capacity - room, True))
            if n == use * copies:
                waiting.pop(at)
            else:
                waiting[at][1:] = first + use * copies, n - use * copies
            if bins > use:
                open_.append((room, bin_ + use, bins - use, fits))
            if room > copies * size:
                open_.append((room - copies * size, bin_, use, fits + 1))
    out += [(PIECES, s, f, n, 0, 0, 0, 0, False) for s, f, n in itertools.chain(waiting, pieces[k:])]
    return out


def _swept(runs: DataFrame, by: str, capacity: int) -> DataFrame:
    """The sweep inside each group; rows of gaps matched already and matches pass through."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        idle = ~frame["fresh"] & (frame["kind"] != MATCHES)
        rows = lambda k: list(frame.loc[idle & (frame["kind"] == k), ["size", "first", "n"]].itertuples(index=False, name=None))
        new = pd.DataFrame(sweep(rows(PIECES), rows(GAPS), capacity), columns=RUN_COLUMNS)
        return pd.concat([frame.loc[~idle, RUN_COLUMNS], new]) if len(new) else frame.loc[~idle, RUN_COLUMNS]

    return runs.withColumn("range", F.expr(by)).groupBy("range").applyInPandas(run, RUN_SCHEMA)


def _opened(runs: DataFrame, bins: int, first_bin: int, capacity: int) -> DataFrame:
    """The ``bins`` largest pieces open a sequence each."""
    before = Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 runs
    pieces = runs.filter(F.col("kind") == PIECES).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    use = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(bins) - F.col("before")))
    pieces = pieces.withColumn("use", use).withColumn("at", F.lit(first_bin) + F.col("before"))
    row = lambda **k: [(F.lit(v) if not hasattr(v, "alias") else v).cast(t).alias(c) for c, t in (x.split() for x in RUN_SCHEMA.split(", ")) for v in [k.get(c, 0)]]
    rest = pieces.filter("n > use").select(*row(kind=PIECES, size=F.col("size"), first=F.col("first") + F.col("use"), n=F.col("n") - F.col("use"), fresh=False))
    gap = pieces.filter(f"use > 0 and size < {capacity}").select(*row(kind=GAPS, size=F.lit(capacity) - F.col("size"), first=F.col("at"), n=F.col("use"), fresh=False))
    match = pieces.filter("use > 0").select(*row(kind=MATCHES, size=F.col("size"), first=F.col("first"), n=F.col("use"), bin=F.col("at"), bins=F.col("use"), copies=1, fresh=True))
    return rest.unionByName(gap).unionByName(match).unionByName(runs.filter(F.col("kind") == GAPS))


def best_fit_plan(lengths: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Match rows for a table (length, n) of pieces: which ranks of a length go where."""
    zero = [F.lit(0).cast("long").alias(c) for c in ("bin", "bins", "copies", "offset")]
    runs = lengths.select(F.lit(PIECES).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n"), *zero, F.lit(False).alias("fresh"))
    runs = scratch.cut(runs, "runs")
    plan, next_bin, placed = [], 0, 0
    while True:
        left = runs.filter(F.col("kind") == PIECES).agg(F.sum("n"), F.sum(F.col("n") * F.col("size")), F.sum(F.when(F.col("size") * 2 > capacity, F.col("n")))).first()
        pieces, volume, large = (int(x or 0) for x in left)
        if not pieces:
            break
        if not placed:  # nothing fits any gap: as many new sequences as the rest needs at least
            bins = min(pieces, max(-(-volume // capacity), large))
            step, next_bin = _opened(runs, bins, next_bin, capacity), next_bin + bins
            placed = pieces
        else:
            step = _swept(runs, f"size * {RANGES} div {capacity + 1}", capacity)
            step = _swept(step, "0", capacity)
        step = scratch.cut(step.coalesce(1), "round")
        plan.append(step.filter(F.col("kind") == MATCHES))
        done = plan[-1].agg(F.sum("n")).first()[0]
        placed = int(done or 0)
        runs = step.filter(F.col("kind") != MATCHES).withColumn("fresh", F.lit(False))
    if not plan:
        return runs.filter("false")
    out = plan[0]
    for p in plan[1:]:
        out = out.unionByName(p)
    return scratch.cut(out, "plan")


def ranked(pieces: DataFrame, lengths: DataFrame) -> DataFrame:
    """``pieces`` with rank: 0, 1, 2, ... within each length.

    Rows of a length are dealt to buckets by hash, more for frequent lengths; counts of buckets give
    their offsets, and only rows of one bucket are numbered together.
    """
    buckets = lengths.select("length", (F.greatest(F.lit(LEAST_BUCKETS), F.col("n") / BUCKET_ROWS)).cast("long").alias("buckets"))
    dealt = pieces.join(F.broadcast(buckets), "length")  # at most 4096 rows
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets"))
    per = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(own)).join(per, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` is read several times, so it should be a table."""
    lengths = scratch.cut(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = best_fit_plan(lengths, scratch, capacity)
    blocks = plan.select(F.col("size").alias("length"), F.col("first").alias("low"), (F.col("first") + F.col("n")).alias("high"), "bin", "copies", F.col("offset").alias("at"), F.explode(F.expr(f"sequence(first div {RANK_BLOCK}, (first + n - 1) div {RANK_BLOCK})")).alias("block"))
    blocks = scratch.cut(blocks, "blocks")  # a table, so that its real size is known when the join is planned
    rows = ranked(pieces, lengths).withColumn("block", F.expr(f"rank div {RANK_BLOCK}"))
    out = rows.join(blocks, ["length", "block"]).filter("rank >= low and rank < high")
    place = F.col("rank") - F.col("low")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.expr("(rank - low) div copies")).alias("sequence_id"), (F.col("at") + F.pmod(place, "copies") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are ignored.  Null and empty texts are the end id
    alone.  A longer document than a sequence is cut into pieces that fill theirs, its last piece is
    packed like any other.  Repeated rows are packed each; an empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.cut(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack(pieces, scratch, capacity)
