"""State, streams and names of families, where a small case says more than a table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F


def test_family_titles(spark):
    from precioscope.operators.views import family_titles

    names = [("a", "Maquina De Sorvete Ninja CREAMI 110V"), ("a", "Máquina de sorvete ninja Creami Deluxe"), ("a", "Nova Máquina De Sorvete Ninja Creami"), ("b", "Xy 1"), ("b", "Ab 2"), ("c", None), ("d", "iphone 15 Pro Max"), ("d", "Apple iPhone 15 Pro"), ("d", "IPHONE 15 pro 256")]
    products = spark.createDataFrame([(q, i, n) for i, (q, n) in enumerate(names)], "query_id string, ordinal int, name string")
    queries = spark.createDataFrame([("a", "x"), ("b", "tenis de corrida"), ("c", None), ("d", "y")], "query_id string, text string")
    got = {r["query_id"]: r["title"] for r in family_titles(products, queries).collect()}
    assert got == {"a": "Máquina de Sorvete Ninja Creami", "b": "Tenis de corrida", "c": "Produtos", "d": "iPhone 15 Pro"}
    assert family_titles(products.filter("false"), queries).count() == 0


def test_import_refuses(spark, tmp_path):
    from precioscope.sources.tables import import_state

    one, none = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([], "a int")
    import_state({"products": one, "offers": none}, f"{tmp_path}/s")
    import_state({"offers": one}, f"{tmp_path}/s")  # it was empty
    with pytest.raises(ValueError, match="offers, products"):
        import_state({"products": one, "offers": one, "more": one}, f"{tmp_path}/s")
    assert not (tmp_path / "s/more").exists()
    import_state({"products": none, "offers": one}, f"{tmp_path}/s", replace=True)
    assert spark.read.schema("a int").json(f"{tmp_path}/s/products").count() == 0


def test_late_readings_and_sink(spark, tmp_path):
    """A reading behind the watermark gives no event, and the sink holds each batch once."""
    from precioscope.streaming.alerts import event_sink, live_events, running

    def put(name, rows):
        lines = [json.dumps({"product_id": 1, "store_id": "s", "seq": s, "ts": t.isoformat(), "price": p, "available": True}) for s, t, p in rows]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines))

    day = lambda n: dt.datetime(2024, 1, n, 12)
    schema = "product_id long, store_id string, seq long, ts timestamp, price double, available boolean"

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        q = event_sink(live_events(stream), f"{tmp_path}/out", f"{tmp_path}/check").queryName("alerts").trigger(availableNow=True).start()
        q.awaitTermination()

    put("1.json", [(1, day(1), 100.0), (2, day(20), 90.0)])
    drain()
    put("2.json", [(3, day(2), 1.0), (4, day(21), 50.0)])
    drain()
    got = {(r["kind"], r["seq"]) for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert got == {("change_point", 1), ("change_point", 2), ("price_drop", 2), ("all_time_low", 2), ("change_point", 4), ("price_drop", 4), ("all_time_low", 4)}
    assert running(spark, "alerts") is None


def test_round_keeps_archived_products_out(spark):
    from precioscope.operators.lifecycle import write_round

    at = dt.datetime(2024, 1, 1)
    rows = [("q", "k1", "s", 10.0, "a", 5, 1, 1, at), ("q", "k1", "s", 8.0, "a", 4, 2, 2, at), ("q", "k2", "s", 7.0, "b", 3, 3, 3, at), ("q", "k3", "s", None, "c", 9, 4, 4, at), ("q", "k4", "s", 1.0, "d", 1, 5, 5, at)]
    candidates = spark.createDataFrame(rows, "query_id string, identity_key string, store_id string, price double, name string, score int, ordinal int, seq long, ts timestamp_ntz")
    products = spark.createDataFrame([("q", "k1", "p1", False), ("q", "k2", "p2", True)], "query_id string, identity_key string, product_id string, archived boolean")
    offers = spark.createDataFrame([("p1", "s", 12.0, None, 0, at, "old", False, 3)], "product_id string, store_id string, price double, previous_price double, seq long, ts timestamp_ntz, title string, available boolean, absent_rounds int")
    done = write_round(candidates, products, offers, cap=3)
    assert {(r["product_id"], r["archived"]) for r in done.products.collect()} == {("p1", False), ("p2", True), ("q/k3", False)}
    assert {(r["product_id"], r["price"], r["previous_price"], r["available"], r["absent_rounds"]) for r in done.offers.collect()} == {("p1", 8.0, 12.0, True, 0), ("q/k3", None, None, True, 0)}
    assert done.readings.filter(F.col("product_id") == "p2").count() == 0
