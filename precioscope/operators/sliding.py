"""Least price of a sliding time window, without one window over a product's whole history.

Time is cut into blocks, ``parts`` to a window.  A window is then the end of its first block, the whole blocks
after it, and the beginning of its last block.  Beginnings and ends are running minima inside one block of a
product; whole blocks are met through one row a block.  So the readings of one product, however many,
are dealt over as many tasks as there are blocks, and equal times are merged before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precioscope.operators.history import has_price

DAY = 86_400_000_000  # microseconds


def sliding_low(readings: DataFrame, days: int, parts: int = 32) -> DataFrame:
    """Each priced reading with low: the product's least price from ``days`` days before it up to its own time.

    Readings of one time see each other.  Readings without a time have no window, so their low is null; repeated
    rows and all columns stay.
    """
    if parts < 2 or days * DAY % parts:
        raise ValueError("parts must be 2 or more and cut the window into whole microseconds")
    width = days * DAY // parts
    timed = readings.filter(has_price()).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    points = timed.filter("_at is not null").groupBy("product_id", "_at").agg(F.min("price").alias("_price"))
    points = points.withColumn("_block", F.expr(f"(_at - pmod(_at, {width}L)) div {width}L"))
    # Each time asks twice: in its own block for the beginning, and ``parts`` blocks earlier for the end.
    own = points.select("product_id", "_block", "_at", "_price", F.col("_at").alias("_of"), F.lit(True).alias("_is_own"))
    asks = points.select("product_id", (F.col("_block") - parts).alias("_block"), (F.col("_at") - days * DAY).alias("_at"), F.lit(None).cast(points.schema["_price"].dataType).alias("_price"), F.col("_at").alias("_of"), F.lit(False).alias("_is_own"))
    block = Window.partitionBy("product_id", "_block")
    begin = F.min("_price").over(block.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    end = F.min("_price").over(block.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0))
    edges = own.union(asks).withColumn("_begin", begin).withColumn("_end", end)
    edges = edges.groupBy("product_id", "_of").agg(F.min(F.when(F.col("_is_own"), F.col("_begin")).otherwise(F.col("_end"))).alias("_edge"), F.max(F.when(F.col("_is_own"), F.col("_block"))).alias("_block"))
    blocks = points.groupBy("product_id", "_block").agg(F.min("_price").alias("_price"))
    between = F.min("_price").over(Window.partitionBy("product_id").orderBy("_block").rangeBetween(1 - parts, -1))  # one row a block
    whole = blocks.select("product_id", "_block", between.alias("_whole"))
    lows = edges.join(whole, ["product_id", "_block"]).select("product_id", F.col("_of").alias("_at"), F.least("_edge", "_whole").alias("low"))
    return timed.join(lows, ["product_id", "_at"], "left").select(*readings.columns, "low")


def sliding_stream(readings: DataFrame, days: int = 90, lateness: str = "1 day") -> DataFrame:
    """(product_id, first_day, last_day, low) of each run of ``days`` days of a stream of ``readings``, a day apart, put out
    once the watermark has passed it.  Days are made first, so a reading is not copied into every window."""
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).filter(has_price())
    daily = timed.groupBy("product_id", F.window("ts", "1 day").alias("_day")).agg(F.min("price").alias("low"))
    runs = daily.groupBy("product_id", F.window(F.window_time("_day"), f"{days} days", "1 day").alias("_run")).agg(F.min("low").alias("low"))
    return runs.select("product_id", F.to_date("_run.start").alias("first_day"), F.date_sub(F.to_date("_run.end"), 1).alias("last_day"), "low")
