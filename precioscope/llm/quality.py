"""Op 1: quality classifier by nearest-neighbour voting among latent-semantic vectors.

A bounded sample of labelled documents (at most SAMPLE_PER_CLASS of each label, taken in hash order)
gives term weights, a truncated singular value decomposition and the labelled vectors.  That model has
a fixed size bound, is sent to every task, and each document's cosine products with all labelled
vectors are computed exactly, block by block, as matrix products.  Labels of the nearest vote with
weights that grow with their similarity.  Terms are counted over whole texts: byte pairs, word shapes
and bands of simple statistics, each a column of the term table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.llm.arrowtext import chunked, hash_spans, spans

#: Bound of the labelled sample that the model is fitted on, per label.
SAMPLE_PER_CLASS = 1500
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 12.0
PAIRS = 1024
SHAPES = 32
STATS, STEPS = 10, 16
TERMS = PAIRS + SHAPES + STATS * STEPS
STAT_WEIGHT = 1.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _per(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weight, minlength=n)


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct items, count of the most frequent one) of each document."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], run)
    return _per(d[at], n), top


def term_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts, damped, of each text: a row of TERMS columns."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    where = np.repeat(np.arange(n), length)
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 1:
        pair = ((data[:-1].astype(np.uint32) << np.uint32(8)) | data[1:]) * np.uint32(0x9E3779B1) >> np.uint32(22)
        same = where[:-1] == where[1:]
        flat = where[:-1][same] * PAIRS + pair[same]
        counts = np.bincount(flat, minlength=n * PAIRS).reshape(n, PAIRS)
        damped = np.log1p(counts)
        out[:, :PAIRS] = damped / np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)
    start, end, doc = spans(data, offsets)
    words = _per(doc, n)
    h = hash_spans(data, start, end)
    size = end - start
    upper, letter, digit = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _LETTER, _DIGIT))
    u, a, g = upper[end] - upper[start], letter[end] - letter[start], digit[end] - digit[start]
    last = data[end - 1] if len(end) else data[:0]
    shape = np.minimum(size, 15) // 4 + 4 * (u > 1) + 8 * (a < size - 1) + 16 * ((g > 0) | (last == 33))
    shapes = np.log1p(np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES))
    out[:, PAIRS : PAIRS + SHAPES] = shapes / np.maximum(np.linalg.norm(shapes, axis=1, keepdims=True), 1e-9)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, top = _repeats(doc, h, n)
    ls, le, ld = spans(data, offsets, _LINE)
    lines = _per(ld, n)
    line_distinct, _ = _repeats(ld, hash_spans(data, ls, le), n)
    by_byte = lambda table: np.bincount(where, weights=table[data], minlength=n)
    letters = by_byte(_LETTER)
    stats = [
        1 - _share(distinct, words) ** 0.5 * np.minimum(1, words / 8),
        _share(top, words),
        _share(_per(doc, n, again.astype(float)), words),
        _share(by_byte(_UPPER), letters),
        1 - _share(letters, length - by_byte(np.isin(np.arange(256), [32, 10, 9]))),
        _share(by_byte(_DIGIT), length),
        _share(_per(doc, n, size.astype(float)), words) / 16,
        np.log1p(words) / 10,
        1 - _share(line_distinct, lines),
        _share(_per(doc, n, (last == 33).astype(float)), words),
    ]
    base = PAIRS + SHAPES
    for k, s in enumerate(stats):
        x = np.clip(s, 0, 1) * (STEPS - 1)
        low = np.minimum(x.astype(int), STEPS - 2)
        rows = np.arange(n)
        out[rows, base + k * STEPS + low] = STAT_WEIGHT * (1 - (x - low))
        out[rows, base + k * STEPS + low + 1] = STAT_WEIGHT * (x - low)
    return out


class VoteModel:
    """Term weights, latent axes, labelled vectors and their votes."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, prior: float):
        self.prior = prior
        seen = (rows > 0).mean(0)
        self.weight = np.log((1 + 1) / (seen + 1 / max(len(rows), 1))).clip(0.05).astype(np.float32)
        x = rows * self.weight
        self.mean = x.mean(0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = axes[:, ::-1][:, : min(RANK, x.shape[1])].astype(np.float32).copy()
        self.vectors = self._unit(x @ self.axes)
        self.labels = labels.astype(np.float32)
        ones = max(1, int(labels.sum()))
        # The sample is balanced by design; votes are scaled back to the labels' own frequency.
        self.votes = np.where(labels == 1, prior / ones, (1 - prior) / max(1, len(labels) - ones)).astype(np.float32)
        self.votes /= self.votes.mean()

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        v = self._unit((rows * self.weight - self.mean) @ self.axes)
        out, k = np.empty(len(v)), min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(v), 256):
            cos = v[i : i + 256] @ self.vectors.T
            near = np.argpartition(cos, len(self.vectors) - k, axis=1)[:, len(self.vectors) - k :]
            sim = np.take_along_axis(cos, near, 1)
            w = np.exp(SHARPNESS * (sim - 1)) * self.votes[near]
            out[i : i + 256] = (w * self.labels[near]).sum(1) / w.sum(1)
        return out.clip(0, 1)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> VoteModel | float:
    """The model of a bounded labelled sample, or the share of label 1 if one class has no text.

    Only rows of ``labels`` with quality 0 or 1 that are not held out count; a doc_id labelled twice
    takes the lesser label.
    """
    own = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out()).select("doc_id", "quality")
    share = own.agg(F.avg("quality")).first()[0]
    prior = 0.5 if share is None else float(share)
    order = [F.xxhash64("doc_id"), "doc_id", "quality"]
    picked = [own.filter(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # At most 2 * per_class rows by construction.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # Of several texts of a doc_id the one that sorts first, at every run.
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in chunked(batch.column(2)):
                rows = term_rows(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(1).slice(i, j - i).cast(pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "quality", "terms"])

    found = texts.mapInArrow(run, "doc_id long, quality int, terms binary").orderBy("doc_id").toPandas()
    y = found["quality"].to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return prior if len(y) == 0 else float(y[0])
    x = np.stack([np.frombuffer(t, np.float16) for t in found["terms"]]).astype(np.float32)
    return VoteModel(x, y, prior)


def scored(docs: DataFrame, model: VoteModel | float) -> DataFrame:
    """(doc_id, score) of each row."""
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in chunked(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sent.value.score(term_rows(data, offsets)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts are scored like any text (by their statistics); repeated rows stay; rows
    with a null doc_id are scored and not held out.  Of labelled vectors that are equally near the
    one earlier by doc_id may vote, so equal texts have equal scores.  A labelled doc_id with several
    texts counts once, with the text that sorts first.  Without usable labels of both kinds every
    score is the labels' share of ones (0.5 if there are none).  Other columns are ignored; an empty
    table gives no row.
    """
    return scored(docs, fit(docs, labels, per_class)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with their columns."""
    model = fit(docs, labels, per_class)
    if isinstance(model, float):
        return docs if model >= least else docs.filter("false")
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, offsets, data in chunked(batch.column(text)):
                keep = sent.value.score(term_rows(data, offsets)) >= least
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
