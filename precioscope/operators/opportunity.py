"""Opportunity rules over readings with running facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.config import DEFAULTS
from precioscope.operators.history import has_price, is_available, with_running

COLUMNS = ("kind", "product_id", "store_id", "seq", "ts", "price", "reference_price", "percent")


def price_drops(running: DataFrame, least_percent: float = DEFAULTS.relevant_drop) -> DataFrame:
    """Readings at least ``least_percent`` below the same offer's price before; percent is negative."""
    drop = (F.col("previous_price") - F.col("price")) / F.col("previous_price") * 100
    hit = has_price() & has_price("previous_price") & (F.col("price") < F.col("previous_price")) & (drop >= least_percent)
    return _rows(running.filter(hit), "price_drop", F.col("previous_price"), -drop)


def new_lows(running: DataFrame) -> DataFrame:
    """Readings strictly below everything seen of the product before; the first one is none."""
    hit = has_price() & (F.col("price") < F.col("minimum_before"))
    below = (F.col("minimum_before") - F.col("price")) / F.col("minimum_before") * 100
    return _rows(running.filter(hit), "all_time_low", F.col("minimum_before"), -below)


def below_target(readings: DataFrame, targets: DataFrame, read_events: DataFrame | None = None) -> DataFrame:
    """The first reading at or below the product's target while no such notice is unread.

    ``targets`` (product_id, target); ``read_events`` (product_id, seq): the user read the notices.
    Between two reads only the first hit counts.
    """
    hits = readings.join(targets.filter("target > 0"), "product_id").filter(has_price() & (F.col("price") <= F.col("target")))
    if read_events is not None:
        reads = read_events.select("product_id", "seq", F.lit(1).alias("is_read"))
        both = hits.withColumn("is_read", F.lit(0)).unionByName(reads, allowMissingColumns=True)
        past = Window.partitionBy("product_id").orderBy("seq", F.col("is_read").desc()).rowsBetween(Window.unboundedPreceding, 0)
        hits = both.withColumn("epoch", F.sum("is_read").over(past)).filter("is_read = 0")
    else:
        hits = hits.withColumn("epoch", F.lit(0))
    kept = hits.groupBy("product_id", "epoch").agg(F.min_by(F.struct("store_id", "seq", "ts", "price", "target"), "seq").alias("r"))
    return kept.select(F.lit("below_target").alias("kind"), "product_id", F.col("r.store_id").alias("store_id"), F.col("r.seq").alias("seq"), F.col("r.ts").alias("ts"), F.col("r.price").alias("price"), F.col("r.target").alias("reference_price"), F.lit(None).cast("double").alias("percent"))


def best_between_stores(offers: DataFrame, stores: DataFrame | None = None, unread: DataFrame | None = None, least: float = DEFAULTS.store_spread) -> DataFrame:
    """Products whose available offers differ by ``least`` of the dearest or more, with both stores.

    Ties go to the lower seq.  ``stores`` (store_id) must hold both; ``unread`` (product_id, store_id,
    price) are notices still open: the same store within a cent is not told again.
    """
    live = offers.filter(has_price() & is_available())
    per = live.groupBy("product_id").agg(F.count(F.lit(1)).alias("offers"), F.min(F.struct("price", "seq", "store_id")).alias("low"), F.max(F.struct("price", F.col("seq"), "store_id")).alias("high"))
    out = per.filter("offers >= 2").select("product_id", "offers", F.col("low.store_id").alias("store_id"), F.col("low.price").alias("price"), F.col("high.store_id").alias("dear_store"), F.col("high.price").alias("dear_price"))
    out = out.withColumn("spread", (F.col("dear_price") - F.col("price")) / F.col("dear_price")).filter(F.col("spread") >= least)
    if stores is not None:
        known = stores.select("store_id").distinct()
        out = out.join(known, "store_id", "left_semi").join(known.withColumnRenamed("store_id", "dear_store"), "dear_store", "left_semi")
    if unread is not None:
        told = unread.select("product_id", "store_id", F.col("price").alias("told_price"))
        near = F.abs(F.col("told_price") - F.col("price")) < 0.01
        out = out.join(told, (out["product_id"] == told["product_id"]) & (out["store_id"] == told["store_id"]) & near, "left_anti")
    return out


def opportunities(readings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """All per-reading opportunities; a reading can give several."""
    running = with_running(readings)
    out = price_drops(running).unionByName(new_lows(running))
    return out.unionByName(below_target(readings, targets)) if targets is not None else out


def latest_opportunities(found: DataFrame, most: int = 200) -> DataFrame:
    """The feed: newest first."""
    return found.orderBy(F.col("ts").desc(), F.col("seq").desc(), "kind").limit(most)


def _rows(df: DataFrame, kind: str, reference, percent) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "product_id", "store_id", "seq", "ts", "price", reference.alias("reference_price"), percent.alias("percent"))
