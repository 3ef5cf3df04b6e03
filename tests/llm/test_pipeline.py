"""The pipeline: odd columns, empty tables, and run() against its stages."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ODD = ("_row", "row", "key", "n_lines", "n_removed", "size", "tie", "a.b", "score", "held_out")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in ODD) + ", m map<string,int>"


def odd_rows():
    texts = ["the quick brown fox jumps over the lazy dog near the old river bank\nand a second line with many words in it", "the quick brown fox jumps over the lazy dog near the old river bank", None, "", "one two three", "entirely different words stand here and they go on for a while yet"]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)] + [(0, texts[0], "en", "web"), (None, texts[5] + " more", "en", None)]
    return [(*r, *(f"{c}-{r[0]}" for c in ODD), {"k": i}) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(0, 1, 0), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_odd_columns(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, tables)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in ODD) and "k" in r["m"]
    empty = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), tables)
    assert empty.dtypes == docs.dtypes and empty.count() == 0


def test_near_duplicates_keep_one_row_of_each(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = [(r["doc_id"], r["m"]["k"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, tables).collect()]
    # Rows 0 and 6 are one document, of which one stays; rows 5 and 7 are similar and the one with an id stays.
    assert sorted(x[0] for x in got if x[0] is not None) == [0, 1, 2, 3, 4, 5] and all(x[0] is not None for x in got)


def test_packing_of_odd_and_no_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = corpus_pipeline.packing_stage(spark, docs, tables)
    assert out.filter("start = 0").count() == len(odd_rows())
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), tables).count() == 0


def test_run_is_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tables}/stage-{k}-{os.getpid()}"
        stage(spark, docs, tables).write.parquet(path)
        docs = spark.read.parquet(path)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(map(repr, df.select(*key).collect()))
    assert rows(corpus_pipeline.run(spark, tables)) == rows(docs)
