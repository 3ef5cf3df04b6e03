"""All four kinds of notices over a stream, with what the user has read as a second input.

State per product is typed: a map of stores with their last offer, the least price so far, whether a
target notice is unread, and a list of unread cross-store notices.  A row is decided by the rows before it in
seq order alone, so any split of the stream into micro-batches gives the same notices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from precioscope.config import DEFAULTS
from precioscope.sources.staging import staging_root

NOTICES = "product_id long, kind string, store_id string, seq long, ts timestamp, price double, reference_price double, percent double"
INPUT = ("product_id", "is_read", "store_id", "seq", "ts", "price", "available", "target")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Notices(StatefulProcessor):
    """Rows of one product in seq order; a read event comes before the reading of its seq.  A price of 0 is a
    missing one, or with ``zero`` a price like others."""

    def __init__(self, zero: bool = False):
        self.zero = zero

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.offers = handle.getMapState("offers", "store_id string", "price double, available boolean, seq long, known double")
        self.low = handle.getValueState("low", "price double")
        self.target = handle.getValueState("target_unread", "unread boolean")
        self.unread = handle.getListState("unread", "store_id string, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["seq", "is_read"], ascending=[True, False])
        offers = {k[0]: tuple(v) for k, v in self.offers.iterator()}
        low = self.low.get()[0] if self.low.exists() else None
        waiting = bool(self.target.get()[0]) if self.target.exists() else False
        unread, out, touched = [tuple(x) for x in self.unread.get()], [], set()
        number = lambda x: None if x is None or x != x or x == 0 else float(x)
        for is_read, store, seq, ts, price, flag, target in frame[list(INPUT[1:])].itertuples(index=False):
            if is_read:
                waiting, unread = False, []
                continue
            price, target = (0.0 if self.zero and price == 0 else number(price)), number(target)
            flag = None if flag is None or flag != flag else bool(flag)
            known = offers[store][3] if store in offers else None
            tell = lambda kind, at=store, p=price, ref=None, pct=None: out.append((key[0], kind, at, seq, ts, p, ref, pct))  # noqa: B023, E731
            if price is not None:
                if known and price < known and (known - price) / known * 100 >= DEFAULTS.relevant_drop:
                    tell("price_drop", ref=known, pct=-((known - price) / known * 100))
                if low is not None and price < low:
                    tell("all_time_low", ref=low, pct=-((low - price) / low * 100))
                if target and price <= target and not waiting:
                    tell("below_target", ref=target)
                    waiting = True
                low = price if low is None else min(low, price)
            offers[store] = (price, flag, seq, known if price is None else price)
            touched.add(store)
            live = [(o[0], o[2], s) for s, o in offers.items() if o[0] is not None and o[1] is not False]
            if len(live) >= 2 and max(live)[0]:
                cheap, dear = min(live), max(live)
                spread = (dear[0] - cheap[0]) / dear[0]
                if spread >= DEFAULTS.store_spread and not any(s == cheap[2] and abs(p - cheap[0]) < 0.01 for s, p in unread):
                    tell("best_between_stores", at=cheap[2], p=cheap[0], ref=dear[0], pct=-(spread * 100))
                    unread.append((cheap[2], cheap[0]))
        for store in touched:
            self.offers.updateValue((store,), offers[store])
        if low is not None:
            self.low.update((low,))
        self.target.update((waiting,))
        self.unread.put(unread) if unread else self.unread.clear()
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in NOTICES.split(", ")])
        yield frame.astype({"price": float, "reference_price": float, "percent": float})

    def close(self) -> None:
        pass


def live_notices(readings: DataFrame, reads: DataFrame | None = None, targets: DataFrame | None = None, lateness: str = "1 day", zero: bool = False) -> DataFrame:
    """price_drop, all_time_low, below_target and best_between_stores notices of a stream of ``readings``
    (product_id, store_id, seq, ts, price, available).

    ``reads`` (product_id, seq, ts): the user read the product's notices; what was told before may be told
    again.  ``targets`` (product_id, target) is a table.  Rows behind the watermark are left out.  With ``zero`` a price of 0
    is a price (something is given away), else it is a missing one.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = readings.select("product_id", F.lit(False).alias("is_read"), F.col("store_id").cast("string").alias("store_id"), "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("price").cast("double").alias("price"), "available")
    if reads is not None:
        rows = rows.unionByName(reads.select("product_id", F.lit(True).alias("is_read"), none("string").alias("store_id"), "seq", F.col("ts").cast("timestamp").alias("ts"), none("double").alias("price"), none("boolean").alias("available")))
    rows = rows.withWatermark("ts", lateness)
    rows = rows.withColumn("target", none("double")) if targets is None else rows.join(targets.select("product_id", F.col("target").cast("double").alias("target")), "product_id", "left")
    return rows.select(*INPUT).groupBy("product_id").transformWithStateInPandas(Notices(zero), NOTICES, "append", "EventTime")


def drained(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over what there is and reads the table that it wrote; a micro-batch that is tried again
    replaces its own folder, and nothing passes through the driver."""
    import uuid

    spark: SparkSession = stream.sparkSession
    root = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    path, checkpoint = path or f"{root}/out", checkpoint or f"{root}/checkpoint"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # a table even where no row comes
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
