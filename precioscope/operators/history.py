"""Price history: change points, running facts, daily series.

A reading is (product_id, store_id, seq, ts, price, available); seq is arrival order, which is what
"last" means everywhere, and ts is UTC.  A missing price is null or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("product_id", "store_id")


def has_price(price: str | Column = "price") -> Column:
    return F.coalesce(F.col(price) if isinstance(price, str) else price, F.lit(0)) != 0


def is_available(flag: str = "available") -> Column:
    """Unknown availability counts as available."""
    return F.coalesce(F.col(flag), F.lit(True))


def change_points(readings: DataFrame) -> DataFrame:
    """Readings that differ from the one before in their product and store, with confirmed_at and
    confirmations: the last time and number of readings of the island that each begins."""
    order = Window.partitionBy(*PAIR).orderBy("seq")
    same = F.col("price").eqNullSafe(F.lag("price").over(order)) & F.col("available").eqNullSafe(F.lag("available").over(order))
    marked = readings.withColumn("starts", ((F.row_number().over(order) == 1) | ~same).cast("int"))
    marked = marked.withColumn("island", F.sum("starts").over(order))
    island = Window.partitionBy(*PAIR, "island")
    out = marked.withColumn("confirmed_at", F.max("ts").over(island)).withColumn("confirmations", F.count(F.lit(1)).over(island))
    return out.filter("starts = 1").drop("starts", "island")


def with_running(readings: DataFrame) -> DataFrame:
    """previous_price: the pair's last known price before; minimum_before: the product's least so far."""
    priced = F.when(has_price(), F.col("price"))
    pair = Window.partitionBy(*PAIR).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    product = Window.partitionBy("product_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return readings.withColumn("previous_price", F.last(priced, ignorenulls=True).over(pair)).withColumn("minimum_before", F.min(priced).over(product))


def current_offers(readings: DataFrame) -> DataFrame:
    """The latest reading of each product and store: a map-side maximum, no sort."""
    rest = [c for c in readings.columns if c not in PAIR]
    latest = readings.groupBy(*PAIR).agg(F.max_by(F.struct(*rest), "seq").alias("row"))
    return latest.select(*PAIR, *[F.col(f"row.{c}").alias(c) for c in rest])


def lowest_ever(readings: DataFrame) -> DataFrame:
    """Least price of each product and when it was first seen."""
    first = F.min(F.when(has_price(), F.struct("price", "seq", "ts", "store_id")))
    out = readings.groupBy("product_id").agg(first.alias("m")).filter("m is not null")
    return out.select("product_id", F.col("m.price").alias("lowest_price"), F.col("m.ts").alias("lowest_at"), F.col("m.store_id").alias("lowest_store"))


def daily_series(readings: DataFrame) -> DataFrame:
    """Per product and UTC day: least and greatest price, the store that had the least first, readings."""
    priced = readings.filter(has_price()).withColumn("day", F.to_date("ts"))
    first = F.min(F.struct("price", "ts", "seq", "store_id"))
    return priced.groupBy("product_id", "day").agg(F.min("price").alias("low"), F.max("price").alias("high"), first["store_id"].alias("low_store"), F.count(F.lit(1)).alias("readings"))


def filled_series(readings: DataFrame, as_of: Column | str, days: int = 60) -> DataFrame:
    """The daily series with gaps carried forward and marked as estimated.

    The window is the last ``days`` days to ``as_of``; it begins at a product's first day if that is
    later, and an older price never fills its beginning.  A first day inside the window ends the
    series a day early while ``as_of`` is before noon.
    """
    as_of = F.lit(as_of) if isinstance(as_of, str) else as_of
    daily = daily_series(readings)
    noon = F.make_interval(hours=F.lit(12))
    span = daily.groupBy("product_id").agg(F.min("day").alias("first_day"))
    span = span.withColumn("as_of", as_of.cast("timestamp_ntz"))
    start = F.col("first_day").cast("timestamp_ntz") + noon
    limit = F.col("as_of") - F.make_interval(days=F.lit(days - 1))
    late = start > limit
    span = span.withColumn("from_day", F.when(late, F.col("first_day")).otherwise(F.to_date(limit)))
    last = F.when(late & (F.hour("as_of") < 12), F.date_sub(F.to_date("as_of"), 1)).otherwise(F.to_date("as_of"))
    span = span.withColumn("to_day", last).filter("to_day >= from_day")
    calendar = span.select("product_id", F.explode(F.sequence("from_day", "to_day")).alias("day"))
    joined = calendar.join(daily, ["product_id", "day"], "left")
    past = Window.partitionBy("product_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda c: F.last(c, ignorenulls=True).over(past).alias(c)
    out = joined.select("product_id", "day", carry("low"), carry("high"), carry("low_store"), F.coalesce("readings", F.lit(0)).alias("readings"), F.col("readings").isNull().alias("estimated"))
    return out.filter("low is not null")


def absence_streaks(seen: DataFrame, rounds: DataFrame) -> DataFrame:
    """(product_id, store_id, round_no, absent): rounds in a row without a reading of a known pair.

    ``seen`` (product_id, store_id, round_no), ``rounds`` (round_no): only rounds that have any.  Rounds are
    ranked, a reading spans the ranks up to the pair's next one, and only those are put out: no pair
    is compared with a round."""
    ranked = rounds.distinct().withColumn("rank", F.row_number().over(Window.orderBy("round_no")))  # one row a round
    hits = seen.select(*PAIR, "round_no").distinct().join(ranked, "round_no")
    hits = hits.join(ranked.agg(F.max("rank").alias("top")))  # one row
    following = F.coalesce(F.lead("rank").over(Window.partitionBy(*PAIR).orderBy("rank")) - 1, F.col("top"))
    spans = hits.withColumn("upto", following).select(*PAIR, F.col("round_no").alias("last"), F.explode(F.sequence("rank", "upto")).alias("rank"))
    return spans.join(ranked, "rank").select(*PAIR, "round_no", (F.col("round_no") - F.col("last")).alias("absent"))


def vanished(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known offers of stores that were read this round but did not show them; manual ones are exempt."""
    stores = seen.select("store_id").distinct()
    auto = known.filter(~F.coalesce(F.col("manual"), F.lit(False))) if "manual" in known.columns else known
    return auto.join(stores, "store_id", "left_semi").join(seen.select(*PAIR).distinct(), list(PAIR), "left_anti")
