"""Scopes, sliding minima, timed back-off, bronze rows, paged reads and table functions against plain versions."""

import datetime
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

START = datetime.datetime(2024, 1, 1)
SCHEMA = "product_id long, store_id string, seq long, ts timestamp, price double, available boolean"


def batches(spark, rows, schema, path, n):
    """``rows`` as a stream of n files, one a micro-batch."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_scopes_by_triples_equal_a_loop(spark):
    from precioscope.operators.scope import store_serves

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 6)))
    lists = lambda n: [(i, r.choice([None, [], *[[word() for _ in range(r.randrange(1, 4))] for _ in range(12)]])) for i in range(n)]
    queries, stores = lists(150), lists(90)
    got = store_serves(spark.createDataFrame(queries + queries[:3], "query_id long, tokens array<string>"), spark.createDataFrame(stores, "store_id long, scope_words array<string>"))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    long = lambda ws: [w for w in ws or [] if len(w) > 2]
    want = sorted((q, s) for q, t in queries + queries[:3] for s, w in stores if not long(w) or any(a in b or b in a for a in long(w) for b in long(t)))
    assert sorted((x["query_id"], x["store_id"]) for x in got.collect()) == want
    assert store_serves(spark.createDataFrame([], "query_id long, tokens array<string>"), spark.createDataFrame(stores, "store_id long, scope_words array<string>")).count() == 0


@pytest.mark.parametrize("parts", [2, 32])
def test_sliding_low_equals_a_loop(spark, parts):
    from precioscope.operators.sliding import sliding_low

    r = random.Random(4)
    hour = datetime.timedelta(hours=1)
    rows = [(r.choice([1, 1, 1, 2, 3]), "s", i, None if i % 50 == 0 else datetime.datetime(1970, 1, 1) + hour * r.randrange(-700, 700), r.choice([None, 0.0, float(r.randrange(1, 99))]), True) for i in range(400)]
    rows += rows[:20]
    got = sliding_low(spark.createDataFrame(rows, SCHEMA), 4, parts)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")] + ["low"]
    week = datetime.timedelta(days=4)
    want = [(p, q, x, None if t is None else min(y for p2, _, _, u, y, _ in rows if y and p2 == p and u is not None and t - week <= u <= t)) for p, _, q, t, x, _ in rows if x]
    assert sorted(map(repr, ((x["product_id"], x["seq"], x["price"], x["low"]) for x in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [1, 5])
def test_backoff_with_timers_equals_the_table(spark, tmp_path, n):
    from precioscope.functions.policy import backoff
    from precioscope.streaming.notices import drained
    from precioscope.streaming.pacing import live_backoff

    r, at, rows = random.Random(7), 1_700_000_000_000, []
    for i in range(200):
        at += r.choice([500, 20_000, 90_000, 700_000])
        rows.append((f"h{r.randrange(4)}", i, r.choice([200, 200, 404, 429, 503]), r.choice([None, None, 5.0, 900.0]), at))
    schema = "host string, ordinal long, status int, retry_after double, at_ms long"
    live = drained(live_backoff(batches(spark, rows, schema, tmp_path / "in", n)), "backoff")
    assert sorted(live.collect()) == sorted(backoff(spark.createDataFrame(rows, schema)).collect())


def test_silent_hosts_leave_no_state(spark, tmp_path):
    from precioscope.streaming.notices import STATE_STORE
    from precioscope.streaming.pacing import live_backoff

    at = 1_700_000_000_000
    rows = [(f"h{i}", i, 429, None, at + i) for i in range(6)] + [("awake", 10 + i, 200, None, at + 1_000_000 * (1 + i)) for i in range(6)]
    out = live_backoff(batches(spark, rows, "host string, ordinal long, status int, retry_after double, at_ms long", tmp_path / "in", 2))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        q = out.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    held = spark.read.format("statestore").option("stateVarName", "gap").load(f"{tmp_path}/check")
    assert held.count() == 0 and spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_late_rows_stay_in_bronze_and_out_of_alerts(spark, tmp_path):
    from precioscope.streaming.bronze import alerts_of, bronze_at, write_bronze
    from precioscope.streaming.notices import drained

    day = datetime.timedelta(days=1)
    rows = [(1, "a", 0, START + 9 * day, 100.0, True), (1, "a", 1, START + 10 * day, 99.0, True), (1, "a", 2, START + 2 * day, 10.0, True), (1, "a", 3, START + 10 * day, 80.0, True), (2, "b", 4, None, 5.0, True), (1, "a", 5, START + 11 * day, 70.0, True)]
    path = str(tmp_path / "bronze")
    write_bronze(batches(spark, rows, SCHEMA, tmp_path / "in", 3), path).start().awaitTermination()
    kept = bronze_at(spark, path, SCHEMA)
    assert sorted((x["seq"], x["late"]) for x in kept.collect()) == [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False)]
    told = drained(alerts_of(spark, path, SCHEMA), "alerts").filter("kind = 'all_time_low'").collect()
    assert sorted(x["seq"] for x in told if x["product_id"] == 1) == [1, 3, 5]
    write_bronze(batches(spark, rows[:0], SCHEMA, tmp_path / "none", 1), str(tmp_path / "empty")).start().awaitTermination()


def test_stream_of_sliding_days(spark, tmp_path):
    from precioscope.operators.sliding import sliding_stream
    from precioscope.streaming.notices import drained

    hour = datetime.timedelta(hours=1)
    r = random.Random(2)
    rows = [(r.randrange(2), "s", i, START + hour * i, r.choice([None, 0.0, float(r.randrange(1, 500))]), True) for i in range(24 * 14)]
    got = {(x["product_id"], x["first_day"], x["last_day"]): x["low"] for x in drained(sliding_stream(batches(spark, rows, SCHEMA, tmp_path / "in", 4), 3), "s").collect()}
    days = {}
    for p, _, _, t, x, _ in rows:
        if x:
            for k in range(3):
                first = t.date() - datetime.timedelta(days=k)
                key = (p, first, first + datetime.timedelta(days=2))
                days[key] = min(x, days.get(key, x))
    assert len(got) >= 20 and all(days[k] == v for k, v in got.items())


def test_paged_source(spark, tmp_path):
    from precioscope.operators.crawl import paged
    from precioscope.sources.paged import append_once, bounds_of, read_paged

    base = str(tmp_path / "shop.db")
    db = sqlite3.connect(base)
    db.execute('CREATE TABLE offers (id INTEGER, name TEXT, price REAL, "on sale" INTEGER, spare BLOB)')
    rows = [(i if i % 40 else None, f"n{i % 7}", None if i % 9 == 0 else i / 4, i % 2, b"x") for i in range(1, 500)]
    db.executemany("INSERT INTO offers VALUES (?, ?, ?, ?, ?)", rows)
    db.commit()
    schema = "id long, name string, price double, `on sale` boolean"
    read = lambda **o: read_paged(spark, schema, database=base, table="offers", key="id", **o)
    want = sorted(map(repr, ((i, n, p, bool(s)) for i, n, p, s, _ in rows)))
    assert sorted(map(repr, map(tuple, read(ranges="5").collect()))) == want and read(ranges="5").rdd.getNumPartitions() == 6
    some = read().filter("price > 20.5 and id <= 400 and name = 'n3'")
    assert sorted(x["id"] for x in some.collect()) == sorted(i for i, n, p, _, _ in rows if i and p and p > 20.5 and i <= 400 and n == "n3")
    assert read().filter("`on sale` and id in (3, 4, 5)").count() == 2 and read().filter("name > 'n5' and price is null").count() == sum(n > "n5" and p is None for _, n, p, _, _ in rows)
    bounds = bounds_of(paged(read().filter("id is not null"), "id", size=100), per_task=2)
    assert read(bounds=bounds).count() == sum(i is not None for i, *_ in rows) and read(bounds=bounds).rdd.getNumPartitions() == 3
    points = spark.createDataFrame([(1, START, 2.0), (2, None, 3.0)], "product_id long, ts timestamp, price double")
    for _ in range(2):
        append_once(points, str(tmp_path / "history"), 1)
    append_once(points.limit(1), str(tmp_path / "history"), 2)
    assert sorted((x["batch"], x["month"]) for x in spark.read.parquet(str(tmp_path / "history")).collect()).count((1, "2024-01")) == 1
    assert spark.read.parquet(str(tmp_path / "history")).count() == 3


def test_table_functions(spark):
    from precioscope.functions.extract import extract_listings
    from precioscope.functions.tables import register_tables

    register_tables(spark)
    html = '<script type="application/ld+json">{"@type":"Product","name":"Cadeira","offers":{"price":"10.50"}}</script><script type="application/ld+json">{"broken</script><p>Cupom CASA10 com 10% de desconto</p>'
    pages = spark.createDataFrame([(1, "https://a.b/p", html), (2, None, None), (3, "https://a.b", "")], "page_id long, url string, html string")
    side = lambda call: spark.sql(f"SELECT p.page_id, l.* FROM {{pages}} p, LATERAL {call} l", pages=pages)
    listed = side("watch_listings(p.html, p.url)")
    assert sorted(map(repr, listed.collect())) == sorted(map(repr, extract_listings(pages).collect())) and listed.count() > 0
    assert [(x["page_id"], x["strategy"]) for x in side("watch_listing_failures(p.html, p.url)").collect()] == [(1, "jsonld")]
    assert [(x["kind"], x["value"]) for x in side("watch_coupons(p.html)").collect()] == [("percent", 10.0)]
