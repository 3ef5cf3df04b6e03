"""Every core query against its SQL, and the stream against the batch."""

import os

import duckdb
import pandas as pd
import pytest

from precioscope import queries as core
from precioscope import queries_diagnosis, queries_entities, queries_flow, queries_state, queries_web  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """One form of a value: missing is None, numbers are floats as long as they are exact."""
    if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 53 else v


def rows(frame: pd.DataFrame, cols: list[str]) -> list[str]:
    return sorted(repr([plain(v) for v in r]) for r in frame[cols].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    ours, theirs = core.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(core.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    assert rows(ours, cols) == rows(theirs, cols)


def test_history_invariants(spark, sf_dir):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    h = core.QUERIES["history_change_points"](spark, sf_dir)
    w = Window.partitionBy("product_id", "store_id").orderBy("seq")
    same = F.col("price").eqNullSafe(F.lag("price").over(w)) & F.col("available").eqNullSafe(F.lag("available").over(w)) & F.lag("seq").over(w).isNotNull()
    assert h.select(same.alias("s")).filter("s").count() == 0
    assert core.QUERIES["price_assessment"](spark, sf_dir).filter("share_dearer < 0 or share_dearer > 1").count() == 0


def test_edges(spark):
    from precioscope.operators import history as H
    from precioscope.operators import opportunity as O

    schema = "product_id long, store_id string, seq long, ts timestamp_ntz, price double, available boolean"
    import datetime as dt

    t = lambda d, h=12: dt.datetime(2024, 1, d, h)
    data = [(1, "a", 1, t(1), 100.0, True), (1, "a", 2, t(2), 100.0, True), (1, "a", 3, t(3), 95.0, True), (1, "a", 4, t(4), None, False), (1, "a", 5, t(5), 95.0, None), (1, "b", 6, t(8), 90.25, True)]
    r = spark.createDataFrame(data, schema)
    assert [x["seq"] for x in H.change_points(r).orderBy("seq").collect()] == [1, 3, 4, 5, 6]
    assert [x["seq"] for x in O.price_drops(H.with_running(r)).collect()] == [3]
    assert [x["seq"] for x in O.new_lows(H.with_running(r)).orderBy("seq").collect()] == [3, 6]
    assert O.best_between_stores(H.current_offers(r)).collect()[0]["spread"] >= 0.05
    filled = H.filled_series(r, "2024-01-08 13:00:00", 5).orderBy("day").collect()
    assert [(x["day"].day, x["low"], x["estimated"]) for x in filled] == [(4 + i, v, e) for i, v, e in ((1, 95.0, False), (2, 95.0, True), (3, 95.0, True), (4, 90.25, False))]
    targets = spark.createDataFrame([(1, 95.0)], "product_id long, target double")
    reads = spark.createDataFrame([(1, 4)], "product_id long, seq long")
    assert [x["seq"] for x in O.below_target(r, targets, reads).orderBy("seq").collect()] == [3, 5]
    empty = spark.createDataFrame([], schema)
    assert H.change_points(empty).count() == 0 and H.filled_series(empty, "2024-01-08 13:00:00").count() == 0


def test_stream_over_several_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from precioscope.operators.history import with_running
    from precioscope.operators.opportunity import new_lows, price_drops
    from precioscope.streaming.alerts import live_events

    rows_ = [(i % 3, f"s{i % 2}", i, float(100 - (i * 37) % 50), True) for i in range(60)]
    df = spark.createDataFrame(rows_, "product_id long, store_id string, seq long, price double, available boolean").withColumn("ts", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("seq"))))
    for k in range(3):
        df.filter(F.floor(F.col("seq") / 20) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live_events(src, "10 days").writeStream.format("memory").queryName("alerts_batches").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["kind"], r["seq"]) for r in spark.table("alerts_batches").filter("kind <> 'change_point'").collect())
    batch = with_running(df)
    want = sorted((r["kind"], r["seq"]) for r in price_drops(batch).unionByName(new_lows(batch)).collect())
    assert got == want


def test_round_and_export(spark, tmp_path):
    from pyspark.sql import functions as F

    from precioscope.plans.round import run_round
    from precioscope.sources.tables import export_rows, write_export
    from tests.test_functions import PAGE

    asked = spark.createDataFrame([(1, "cafeteira oster prima"), (2, "Apple")], "query_id long, text string")
    captures = spark.createDataFrame([(1, s, i, f"https://{s}/busca", PAGE) for i, s in enumerate(("loja.com", "outra.com"))], "query_id long, store_id string, page_id long, url string, html string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    done = run_round(asked, captures)
    offers = done.offers.collect()
    assert {o["store_id"] for o in offers} == {"loja.com", "outra.com"} and min(o["price"] for o in offers) == 900.0
    products = spark.createDataFrame([], "product_id string, product_name string, brand string")
    stores = spark.createDataFrame([("loja.com", "Loja")], "store_id string, store_name string")
    write_export(export_rows(done.readings, products, stores).coalesce(1), f"{tmp_path}/out")
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*")).decode()
    assert text.startswith('"﻿produto";') and "\r\n" in text and '"900,00"' in text
