"""Online change points and opportunities.

Readings arrive with (product_id, store_id, seq, ts, price, available).  State per product holds each
store's last point and price and the product's minimum, so a micro-batch gives exactly what the batch
operators give over all readings so far.  Within a batch a product's readings are taken in seq order;
readings later than the watermark are not alerted on (the bronze table keeps them).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from precioscope.config import DEFAULTS

EVENTS = "product_id long, kind string, store_id string, seq long, ts timestamp, price double, reference_price double, percent double"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else {"stores": {}, "low": None}
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for store, seq, ts, price, flag in rows[["store_id", "seq", "ts", "price", "available"]].itertuples(index=False):
        price = None if price is None or price != price else float(price)
        flag = None if flag is None or flag != flag else bool(flag)
        last = held["stores"].get(store)
        tell = lambda kind, ref=None, pct=None: out.append((key[0], kind, store, seq, ts, price, ref, pct))  # noqa: B023, E731
        if last is None or last["point"] != [price, flag]:
            tell("change_point")
        before = last and last["price"]
        if price:
            if before and price < before and (before - price) / before * 100 >= DEFAULTS.relevant_drop:
                tell("price_drop", before, -((before - price) / before * 100))
            if held["low"] is not None and price < held["low"]:
                tell("all_time_low", held["low"], -((held["low"] - price) / held["low"] * 100))
            held["low"] = price if held["low"] is None else min(held["low"], price)
        held["stores"][store] = {"point": [price, flag], "price": price or before}
    state.update((json.dumps(held),))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
    yield frame.astype({"price": float, "reference_price": float, "percent": float})


def live_events(readings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Change points and opportunities of a stream of readings, appended as they happen."""
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    # With event time as its clock Spark leaves out rows behind the watermark before they reach the state.
    return timed.groupBy("product_id").applyInPandasWithState(_step, EVENTS, "held string", "append", "EventTimeTimeout")


def daily_stream(readings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Tumbling UTC days per product: least, greatest, count; a day closes when the watermark passes it."""
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    out = timed.filter(F.coalesce("price", F.lit(0)) != 0).groupBy("product_id", F.window("ts", "1 day")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("readings"))
    return out.select("product_id", F.to_date("window.start").alias("day"), "low", "high", "readings")


def event_sink(events: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch of events as JSON lines in a folder of its own, so a batch that is tried
    again replaces itself; returns the stream's writer, to be started."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def running(spark: SparkSession, name: str):
    """The active stream of that name, or None: a round starts one only where there is none."""
    return next((q for q in spark.streams.active if q.name == name), None)


def distinct_readings(readings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each reading once, whatever is delivered again within the watermark."""
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.dropDuplicatesWithinWatermark(["product_id", "store_id", "seq"])
