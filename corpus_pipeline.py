"""The corpus pipeline: quality, line dedup, near-duplicate documents, source mix, packing.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precioscope.llm.linededup import dedup_lines
from precioscope.llm.mixing import mix_documents
from precioscope.llm.ngramjoin import ngram_components
from precioscope.llm.packing import pack_documents
from precioscope.llm.quality import keep_good
from precioscope.llm.queries import word_bpe_path
from precioscope.llm.scratch import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5.

    Null and empty texts are scored by their statistics, repeated rows stay together, and without usable
    labels of both kinds the labels' share of ones decides for all.  An empty table stays empty.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _fields(df: DataFrame, columns: list[str], row: str = "row", **instead) -> DataFrame:
    """``columns`` out of the struct ``row``, whatever their names, some of them replaced."""
    return df.select(*[instead.get(c, F.col(row).getField(c)).alias(c) for c in columns])


def _whole(docs: DataFrame) -> F.Column:
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document (or line) has; a document that loses its
    last line with any word goes.

    Null and empty texts stay; rows that repeat a (doc_id, text) lose the same lines; rows without doc_id
    come first in the order.  Other columns pass through whatever their names; an n_chars column is
    counted anew.  An empty table stays empty.
    """
    out = dedup_lines(docs.select(_whole(docs).alias("row"), "doc_id", "text"))
    left = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _fields(left, docs.columns, text=F.col("text"), **counted)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least doc_id (null last), of each component of similar documents.

    Rows are told apart by 128 bits of doc_id and text, so of a doc_id with two texts each has its own
    component, and those without doc_id take part.  Rows equal in both are one document, of which the row
    with the least JSON stays; rows without words stay.  Other columns pass through whatever their names.
    An empty table stays empty.
    """
    scratch = Scratch(spark, "near")
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), "|n").otherwise(F.concat(F.lit("|s"), "text")))
    keyed = docs.select(_whole(docs).alias("row"), F.unhex(F.md5(said)).alias("key"), "doc_id", "text")
    groups = ngram_components(keyed.select(F.col("key").alias("doc_id"), "text"), words=5, percent=80)
    groups = scratch.cut(groups.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count(F.lit(1)).alias("copies")), "groups")
    several = groups.filter("component_id <> key").select("component_id").distinct()
    members = groups.join(several, "component_id", "left_semi")
    named = keyed.select("key", "doc_id").join(members, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("winner"))
    extra = scratch.cut(members.join(named, "component_id").filter("key <> winner").select("key"), "extra")
    repeated = scratch.cut(groups.filter("copies > 1").select("key"), "repeated")
    kept = keyed.select("row", "key").join(extra, "key", "left_anti")
    once = kept.join(repeated, "key", "left_anti").select("row")
    first = kept.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return _fields(once.unionByName(first), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target takes them, in part where a pass ends.

    A null source is a source; texts without words are never taken, so they go; rows that repeat a
    document are one text of it, taken as often as their words are.  An empty table stays empty.
    """
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece; every row is packed, repeated ones too, and a
    null text is the end id alone.  An empty table gives no row."""
    return pack_documents(docs, word_bpe_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Vectors, signatures, permutations and tokenizers are not SQL; tests hold the near-duplicate stage against brute force and run each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before, mark = docs, Scratch.opened()
        docs = scratch.cut(stage(spark, before, sf_dir), name, dictionary=True)
        Scratch.drop_since(mark)
        scratch.drop(before)  # of the pipeline's own tables; the input is none
    return docs
