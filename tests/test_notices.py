"""Streamed notices for any split into micro-batches against a plain fold."""

import random

import pytest

COLUMNS = "product_id long, store_id string, seq long, price double, available boolean"


def fold(rows, reads, targets):
    out, per = [], {}
    for p, s, q, price, flag in sorted([*rows, *((p, None, q, None, None) for p, q in reads)], key=lambda r: (r[0], r[2], r[1] is not None)):
        st = per.setdefault(p, {"o": {}, "known": {}, "low": None, "told": False, "unread": []})
        if s is None:
            st["told"], st["unread"] = False, []
            continue
        if price:
            b = st["known"].get(s)
            if b and price < b and (b - price) / b >= 0.05:
                out.append((p, "price_drop", s, q, price, b))
            if st["low"] is not None and price < st["low"]:
                out.append((p, "all_time_low", s, q, price, st["low"]))
            if p in targets and price <= targets[p] and not st["told"]:
                out.append((p, "below_target", s, q, price, targets[p]))
                st["told"] = True
            st["low"] = price if st["low"] is None else min(st["low"], price)
            st["known"][s] = price
        st["o"][s] = (price, flag, q)
        live = sorted((o[0], o[2], k) for k, o in st["o"].items() if o[0] and o[1] is not False)
        if len(live) > 1 and (live[-1][0] - live[0][0]) / live[-1][0] >= 0.05 and not any(k == live[0][2] and abs(x - live[0][0]) < 0.01 for k, x in st["unread"]):
            out.append((p, "best_between_stores", live[0][2], q, live[0][0], live[-1][0]))
            st["unread"].append((live[0][2], live[0][0]))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_notices_do_not_depend_on_batches(spark, tmp_path, batches):
    from pyspark.sql import functions as F

    from precioscope.streaming.notices import drained, live_notices

    r = random.Random(5)
    rows = [(r.randrange(4), f"s{r.randrange(3)}", i, r.choice([None, 0.0, 80.0, 84.0, 90.0, 90.005, 100.0, 120.0]), r.choice([True, True, None, False])) for i in range(210)]
    reads, targets = [(r.randrange(4), q) for q in range(10, 210, 17)], {0: 85.0, 1: 100.0, 3: 0.0}
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("seq"))
    df = spark.createDataFrame(rows, COLUMNS).withColumn("ts", at)
    rd = spark.createDataFrame(reads, "product_id long, seq long").withColumn("ts", at)
    size = 210 // batches
    for k in range(batches):
        one = lambda d: d.filter(F.floor(F.col("seq") / size) == k).coalesce(1)  # noqa: B023, E731
        one(df).write.mode("append").parquet(f"{tmp_path}/in")
        one(rd).write.mode("append").parquet(f"{tmp_path}/reads")
    stream = lambda d, name: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    known = spark.createDataFrame(list(targets.items()), "product_id long, target double")
    got = drained(live_notices(stream(df, "in"), stream(rd, "reads"), known, "10 days"), "test")
    found = sorted((x["product_id"], x["kind"], x["store_id"], x["seq"], x["price"], x["reference_price"]) for x in got.collect())
    want = fold(rows, reads, {k: v for k, v in targets.items() if v})
    assert found == want and {k[1] for k in want} == {"price_drop", "all_time_low", "below_target", "best_between_stores"}
