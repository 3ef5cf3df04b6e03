"""Per-product and global summaries of offers and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precioscope.operators.history import has_price, is_available, lowest_ever


def _at(as_of: Column | str) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")


def best_offer(offers: DataFrame) -> DataFrame:
    """Cheapest available priced offer of each product, first on ties, and how many there are."""
    live = offers.filter(has_price() & is_available())
    out = live.groupBy("product_id").agg(F.min(F.struct("price", "seq", "store_id")).alias("b"), F.count(F.lit(1)).alias("stores"))
    return out.select("product_id", F.col("b.price").alias("current_price"), F.col("b.store_id").alias("best_store"), "stores")


def price_assessment(history: DataFrame, best: DataFrame, as_of: Column | str, days: int | None = 90) -> DataFrame:
    """How good the current price is: the share of the base that is strictly dearer, the base's mean and
    the distance to it in percent.

    The base is the last ``days`` if they hold 3 readings, else (or with None) everything; fewer than 3 give no row.
    """
    priced = history.filter(has_price()).join(best, "product_id")
    recent = F.lit(True) if days is None else F.col("ts") >= _at(as_of) - F.make_interval(days=F.lit(days))
    dearer = F.col("price") > F.col("current_price")
    one = lambda c: F.when(c, 1).otherwise(0)
    per = priced.groupBy("product_id", "current_price").agg(F.sum(one(recent)).alias("n90"), F.sum(one(recent & dearer)).alias("d90"), F.count(F.lit(1)).alias("n"), F.sum(one(dearer)).alias("d"), F.sum(F.when(recent, _cents("price"))).alias("c90"), F.sum(_cents("price")).alias("c"))
    wide = F.col("n90") < 3
    per = per.withColumn("base", F.when(wide, F.col("n")).otherwise(F.col("n90"))).withColumn("dearer", F.when(wide, F.col("d")).otherwise(F.col("d90"))).filter("base >= 3")
    per = per.withColumn("mean", F.when(wide, F.col("c")).otherwise(F.col("c90")) / F.col("base") / 100)
    share = F.col("dearer") / F.col("base")
    rank = F.when(share >= 0.9, "great").when(share >= 0.6, "good").when(share >= 0.3, "normal").otherwise("poor")
    return per.select("product_id", "current_price", "base", "dearer", share.alias("share_dearer"), rank.alias("rating"), "mean", ((F.col("current_price") - F.col("mean")) / F.col("mean") * 100).alias("from_mean_percent"))


def variation_24h(history: DataFrame, best: DataFrame, as_of: Column | str) -> DataFrame:
    """The last priced reading, of any store, at or before as_of - 24 h: an as-of lookup without a join."""
    old = history.filter(has_price() & (F.col("ts") <= _at(as_of) - F.make_interval(hours=F.lit(24))))
    ref = old.groupBy("product_id").agg(F.max_by("price", "seq").alias("reference_price"))
    return best.join(ref, "product_id").select("product_id", "current_price", "reference_price", ((F.col("current_price") - F.col("reference_price")) / F.col("reference_price") * 100).alias("percent"))


def last_variation(history: DataFrame, best: DataFrame) -> DataFrame:
    """The cheapest store's reading before its last one."""
    own = best.select("product_id", F.col("best_store").alias("store_id"), "current_price")
    pair = history.filter(has_price()).join(own, ["product_id", "store_id"]).select("product_id", "seq", "price", "current_price")
    order = Window.partitionBy("product_id").orderBy(F.col("seq").desc())
    two = pair.withColumn("n", F.row_number().over(order)).filter("n = 2")
    return two.select("product_id", F.col("price").alias("earlier_price"), ((F.col("current_price") - F.col("price")) / F.col("price") * 100).alias("percent"))


def product_summary(history: DataFrame, offers: DataFrame, as_of: Column | str, days: int | None = 90) -> DataFrame:
    """One row per product of the history, with nulls where nothing is known; rated by the last ``days`` (``price_assessment``)."""
    best = best_offer(offers)
    points = history.filter(has_price()).groupBy("product_id").agg(F.count(F.lit(1)).alias("points"))
    day = variation_24h(history, best, as_of).select("product_id", F.col("reference_price").alias("price_24h"))
    last = last_variation(history, best).select("product_id", "earlier_price")
    grade = price_assessment(history, best, as_of, days).select("product_id", "rating", "share_dearer")
    out = history.select("product_id").distinct()
    for part in (best, lowest_ever(history), points, day, last, grade):
        out = out.join(part, "product_id", "left")
    out = out.withColumn("above_lowest", F.col("current_price") - F.col("lowest_price")).withColumn("points", F.coalesce("points", F.lit(0)))
    change = lambda c: (F.col("current_price") - F.col(c)) / F.col(c) * 100
    return out.withColumns({"above_lowest_percent": change("lowest_price"), "percent_24h": change("price_24h"), "percent_last": change("earlier_price")})


def global_summary(summary: DataFrame, history: DataFrame, opened: DataFrame, as_of: Column | str, queries: DataFrame | None = None, stores: DataFrame | None = None) -> DataFrame:
    """One row of counts: products watched, falling, at a new low, readings today, open opportunities, and
    active ones and all of the queries and stores (``active``; by default the stores of the history)."""
    change = F.coalesce(F.col("current_price") - F.col("price_24h"), F.col("current_price") - F.col("earlier_price"))
    products = summary.agg(F.count(F.lit(1)).alias("products"), F.count_if(change < 0).alias("falling"), F.count_if((F.col("above_lowest") == 0) & (F.col("points") > 1)).alias("new_lows"))
    today = history.agg(F.count_if(F.to_date("ts") == F.to_date(_at(as_of))).alias("readings_today"))
    open_ = opened.agg(F.count(F.lit(1)).alias("open_opportunities"))
    out = products.join(today).join(open_)  # aggregates of one row each
    for name, kept in (("queries", queries), ("stores", history.select("store_id").distinct().withColumn("active", F.lit(True)) if stores is None else stores)):
        if kept is not None:
            out = out.join(kept.agg(F.count_if("active").alias(f"{name}_active"), F.count(F.lit(1)).alias(name)))
    return out


def _cents(price: str) -> Column:
    """Whole cents, whose sums do not depend on the order of rows."""
    return F.round(F.col(price) * 100).cast("long")


def average_price(offers: DataFrame) -> DataFrame:
    """Mean price of each product's priced offers and their number."""
    per = offers.filter(has_price()).groupBy("product_id").agg(F.sum(_cents("price")).alias("cents"), F.count(F.lit(1)).alias("offers"))
    return per.select("product_id", (F.col("cents") / F.col("offers") / 100).alias("average_price"), "offers")


def with_upper_median(rows: DataFrame, price: Column, *keys: str) -> DataFrame:
    """(keys, median): element floor(n / 2) of each group's sorted prices, nulls aside: of an even number the
    upper of the two middle ones; null where a group has no price.

    Prices are counted by value before anything is ordered, so that a group costs its distinct prices
    (sorted by a window, which spills) and never an array of its rows.
    """
    counts = rows.groupBy(*keys, price.alias("_price")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.when(F.col("_price").isNotNull(), F.col("_n")).otherwise(0)
    whole = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum(known).over(whole.orderBy(F.col("_price").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    half = F.floor(F.sum(known).over(whole) / 2)
    return counts.withColumn("_half", half).groupBy(*keys).agg(F.min(F.when(F.col("_price").isNotNull() & (F.col("_upto") > F.col("_half")), F.col("_price"))).alias("median"))


def median_name(listings: DataFrame, *keys: str) -> DataFrame:
    """The name of median length in each group (order by length, then ordinal, then name).

    Lengths are counted first, and only the names of a group's median length are put in order.
    """
    names = listings.withColumn("_name", F.trim("name")).filter(F.length("_name") > 0).select(*keys, "ordinal", "_name", F.length("_name").alias("_length"))
    whole = Window.partitionBy(*keys)
    lengths = names.groupBy(*keys, "_length").agg(F.count(F.lit(1)).alias("_n"))
    lengths = lengths.withColumn("_upto", F.sum("_n").over(whole.orderBy("_length").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_half", F.floor(F.sum("_n").over(whole) / 2))
    middle = lengths.filter((F.col("_upto") > F.col("_half")) & (F.col("_upto") - F.col("_n") <= F.col("_half")))
    middle = middle.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_length").alias("_middle"), (F.col("_half") - F.col("_upto") + F.col("_n")).alias("_at"))
    same = F.col("_length") == F.col("_middle")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    placed = names.join(middle, same).withColumn("_place", F.row_number().over(whole.orderBy("ordinal", "_name")) - 1)
    return placed.filter(F.col("_place") == F.col("_at")).select(*keys, F.substring("_name", 1, 180).alias("name"))


def price_position(summary: DataFrame) -> DataFrame:
    """Where the current price lies between the lowest and the highest, 0 to 100; null without a band."""
    band = F.col("highest_price") - F.col("lowest_price")
    at = F.least(F.greatest((F.col("current_price") - F.col("lowest_price")) / band * 100, F.lit(0.0)), F.lit(100.0))
    return summary.withColumn("position", F.when(band > 0, at))


def comparison_bars(offers: DataFrame) -> DataFrame:
    """Width of each offer's bar: 100 * least / price, at least 4."""
    low = F.min("price").over(Window.partitionBy("product_id"))
    return offers.filter(F.col("price") > 0).withColumn("width", F.greatest(100 * low / F.col("price"), F.lit(4.0)))
