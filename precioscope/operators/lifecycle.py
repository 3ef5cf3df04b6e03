"""State of the watch: products, offers and history from round to round.

The state is plain tables.  A round reads them, and gives the new ones and the readings to append;
nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precioscope.config import DEFAULTS
from precioscope.functions.money import tracked_coupon, with_coupon
from precioscope.functions.policy import host_of
from precioscope.operators.history import PAIR, has_price, vanished
from precioscope.operators.score import quota


def _time(x: Column | str) -> Column:
    return (F.lit(x) if isinstance(x, str) else x).cast("timestamp_ntz")


# --- products and offers


def best_per_key(listings: DataFrame, keys: list[str], score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    """One listing of each key: the best score, the first of equals."""
    rest = [c for c in listings.columns if c not in keys]
    best = listings.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(score, -F.col(ordinal))).alias("r"))
    return best.select(*keys, *[F.col("r").getField(c).alias(c) for c in rest])


@dataclass
class Written:
    products: DataFrame
    offers: DataFrame
    readings: DataFrame


def write_round(candidates: DataFrame, products: DataFrame, offers: DataFrame, cap: int = DEFAULTS.products_per_query) -> Written:
    """Accepted listings of a round against the products and offers so far.

    ``candidates``: query_id, identity_key, store_id, price, name, score, ordinal, seq, ts.  A listing
    whose key a product of its query has belongs to it; an archived product takes no listing and is not
    made again.  Keys that no product has become products in order of score, while the query has fewer
    than ``cap``.  Of several listings of a product in one store the lowest price counts.  An offer keeps
    the price that it had before as previous_price.
    """
    known = products.select("query_id", "identity_key", "product_id", F.coalesce("archived", F.lit(False)).alias("_archived"))
    matched = candidates.join(known, ["query_id", "identity_key"], "left").filter(~F.coalesce("_archived", F.lit(False))).drop("_archived")
    fresh = best_per_key(matched.filter("product_id is null").drop("product_id"), ["query_id", "identity_key"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ordinal")
    have = products.groupBy("query_id").agg(F.count(F.lit(1)).alias("_have"))
    fresh = fresh.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= cap).join(have, "query_id", "left").filter(F.col("_place") <= cap - F.coalesce("_have", F.lit(0)))
    made = fresh.select("query_id", "identity_key", F.concat_ws("/", "query_id", "identity_key").alias("product_id"), "name", F.lit(False).alias("archived"), F.col("ts").alias("created_at"))
    everything = products.unionByName(made, allowMissingColumns=True)
    taken = matched.join(made.select("query_id", "identity_key", F.col("product_id").alias("_made")), ["query_id", "identity_key"], "left").withColumn("product_id", F.coalesce("product_id", "_made")).filter("product_id is not null")
    updated, readings = offers_after(taken, offers)
    return Written(everything, updated, readings)


def offers_after(taken: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers and readings after a round's ``taken`` listings (product_id, store_id, price, seq, ts, name,
    ordinal): the lowest price of each product and store counts, the price before is kept."""
    lowest = F.min_by(F.struct("price", "seq", "ts", "name"), F.struct(F.when(has_price(), F.col("price")).otherwise(float("inf")), "ordinal"))
    readings = taken.groupBy(*PAIR).agg(lowest.alias("r")).select(*PAIR, F.col("r.seq").alias("seq"), F.col("r.ts").alias("ts"), F.col("r.price").alias("price"), F.lit(True).alias("available"), F.col("r.name").alias("title"))
    before = offers.select(*PAIR, F.col("price").alias("_price"), F.coalesce("previous_price", F.lit(None).cast("double")).alias("_previous"), F.col("seq").alias("_seq"), F.col("ts").alias("_ts"), F.col("title").alias("_title"), F.col("available").alias("_available"), F.col("absent_rounds").alias("_absent"))
    now = before.join(readings, list(PAIR), "full")
    seen = F.col("seq").isNotNull()
    pick = lambda new, old: F.when(seen, new).otherwise(old)
    updated = now.select(
        *PAIR,
        pick(F.coalesce("price", "_price"), F.col("_price")).alias("price"),
        pick(F.col("_price"), F.col("_previous")).alias("previous_price"),
        pick(F.col("seq"), F.col("_seq")).alias("seq"),
        pick(F.col("ts"), F.col("_ts")).alias("ts"),
        pick(F.col("title"), F.col("_title")).alias("title"),
        pick(F.col("available"), F.col("_available")).alias("available"),
        pick(F.lit(0), F.col("_absent")).alias("absent_rounds"),
    )
    return updated, readings.drop("title")


def settle_vanished(offers: DataFrame, seen: DataFrame, pages: DataFrame, seq: Column, ts: Column | str) -> DataFrame:
    """Offers that the stores read this round did not show, as they are after their page was tried.

    ``pages`` (product_id, store_id, price, available): with a price the offer stays, at that price; else
    it is unavailable with its old price and has been absent one round more.  history_price is what the
    history gets: the page's price, or none.  Manual offers are exempt (vanished).
    """
    gone = vanished(offers, seen)
    page = pages.select(*PAIR, F.col("price").alias("_page"), F.coalesce("available", F.lit(True)).alias("_there"))
    both = gone.join(page, list(PAIR), "left")
    found = has_price("_page")
    return both.select(*PAIR, F.when(found, F.col("_page")).otherwise(F.col("price")).alias("price"), F.when(found, F.col("_there")).otherwise(False).alias("available"), F.when(found, 0).otherwise(F.coalesce("absent_rounds", F.lit(0)) + 1).cast("int").alias("absent_rounds"), F.when(found, F.col("_page")).alias("history_price"), found.alias("found_again"), seq.alias("seq"), _time(ts).alias("ts"))


def page_price(plain: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """The price of a page and where it was read: as it came, or where that has none as a browser shows it."""
    both = plain.select(*keys, F.col("price").alias("_plain")).join(rendered.select(*keys, F.col("price").alias("_shown")), keys, "left")
    return both.select(*keys, F.when(has_price("_plain"), F.col("_plain")).when(has_price("_shown"), F.col("_shown")).alias("price"), F.when(has_price("_plain"), "plain").when(has_price("_shown"), "rendered").otherwise("none").alias("read_from"))


def manual_offers(links: DataFrame, stores: DataFrame, pages: DataFrame) -> DataFrame:
    """Offers of links that people gave: the store is the one of the link's host, www. aside.

    ``links`` (product_id, url), ``stores`` (store_id, origin), ``pages`` (url, price, available).  Each
    link tells what came of it: ok, unknown_store or no_price; only ok ones have an offer (score 100,
    manual, present).  An address that was read several times counts once: by the page read for the link's own
    product, if ``pages`` has product_id, else by the cheapest with a price.
    """
    homes = stores.select("store_id", host_of(F.col("origin")).alias("_host")).groupBy("_host").agg(F.min("store_id").alias("store_id"))
    one = F.min(F.struct((~has_price()).alias("unpriced"), "price", (~F.coalesce("available", F.lit(True))).alias("gone")))
    both = links.withColumn("_host", host_of(F.col("url"))).join(homes, "_host", "left").join(pages.groupBy("url").agg(one.alias("_page")), "url", "left")
    if "product_id" in pages.columns:
        both = both.join(pages.filter("product_id IS NOT NULL").groupBy("product_id", "url").agg(one.alias("_own")), ["product_id", "url"], "left").withColumn("_page", F.coalesce("_own", "_page"))
    both = both.withColumn("price", F.col("_page.price")).withColumn("available", ~F.col("_page.gone"))
    result = F.when(F.col("store_id").isNull(), "unknown_store").when(~has_price(), "no_price").otherwise("ok")
    ok = F.col("result") == "ok"
    out = both.withColumn("result", result)
    return out.select("product_id", "url", "result", F.when(ok, F.col("store_id")).alias("store_id"), F.when(ok, F.col("price")).alias("price"), F.when(ok, F.col("available")).alias("available"), F.when(ok, 100).alias("score"), ok.alias("manual"))


def keep_discounts(offers: DataFrame, pages: DataFrame) -> DataFrame:
    """Offers with what their page tells of discounts: the coupon kept (functions.money.tracked_coupon), the
    cash discount, and discounted: the price with both, null unless it is below the price.

    ``pages``: product_id, store_id, coupons, cash_percent, condition.  An offer without a page loses what it had.
    """
    told = pages.select(*PAIR, tracked_coupon(F.col("coupons")).alias("coupon"), already_cash(F.col("condition"), F.col("cash_percent")).alias("cash_percent"))
    both = offers.drop("coupon", "cash_percent", "discounted").join(told, list(PAIR), "left")
    less = F.when(F.col("coupon").isNotNull(), with_coupon(F.col("price"), F.col("coupon.kind"), F.col("coupon.value"))).otherwise(F.col("price"))
    less = F.round(F.when(F.col("cash_percent") > 0, less * (1 - F.col("cash_percent") / 100)).otherwise(less), 2)
    return both.withColumn("discounted", F.when(less < F.col("price"), less))


def already_cash(condition: Column, percent: Column) -> Column:
    """The cash discount that still applies: none where the price told is the cash price already."""
    return F.when(~F.coalesce(condition.isin("pix", "à vista"), F.lit(False)), percent)


def coupon_checks(offers: DataFrame, as_of: Column | str, per_store: int = DEFAULTS.coupon_checks_per_store, total: int = DEFAULTS.coupon_checks, hours: int = DEFAULTS.coupon_recheck_hours) -> DataFrame:
    """Priced offers whose coupons are due: never checked or not for ``hours``; those never checked come
    first, then the cheapest, at most ``per_store`` of a store and ``total`` in all."""
    stale = F.col("checked_at").isNull() | (F.col("checked_at") <= _time(as_of) - F.make_interval(hours=F.lit(hours)))
    return quota(offers.filter(has_price() & stale), [F.col("checked_at").isNotNull(), F.col("price"), F.col("seq")], per_store, total)


# --- runs


def failure_streaks(attempts: DataFrame) -> DataFrame:
    """(store_id, failures): attempts in a row that failed at the end of each store's ``attempts``
    (store_id, ordinal, ok)."""
    last = F.max(F.when(F.col("ok"), F.col("ordinal")))
    per = attempts.groupBy("store_id").agg(last.alias("_last"))
    both = attempts.join(per, "store_id")
    return both.groupBy("store_id").agg(F.count_if(F.col("_last").isNull() | (F.col("ordinal") > F.col("_last"))).alias("failures"))


def run_counters(readings: DataFrame, round_of: Column) -> DataFrame:
    """Per round: readings, priced ones, stores, new products and new offers (first seen in that round)."""
    r = readings.withColumn("round", round_of)
    per = r.groupBy("round").agg(F.count(F.lit(1)).alias("readings"), F.count_if(has_price()).alias("priced"), F.count_distinct("store_id").alias("stores"))
    first = lambda keys, name: r.groupBy(*keys).agg(F.min("round").alias("round")).groupBy("round").agg(F.count(F.lit(1)).alias(name))
    out = per.join(first(["product_id"], "new_products"), "round", "left").join(first(list(PAIR), "new_offers"), "round", "left")
    return out.na.fill(0, ["new_products", "new_offers"])


def registry_counts(offers: DataFrame, products: DataFrame) -> DataFrame:
    """(kind, id, count): offers of each store, and products of each query that are not archived."""
    stores = offers.groupBy(F.col("store_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("store").alias("kind"), "id", "count")
    asked = products.groupBy(F.col("query_id").cast("string").alias("id")).agg(F.count_if(~F.coalesce("archived", F.lit(False))).alias("count")).select(F.lit("query").alias("kind"), "id", "count")
    return stores.unionByName(asked)


def round_due(last: Column, minutes: Column, as_of: Column) -> Column:
    """Is a round due: never run, or ``minutes`` (0: never by interval) have passed since the last began?"""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return (F.coalesce(minutes, F.lit(0)) > 0) & F.coalesce(age >= minutes.cast("long") * 60_000_000, F.lit(True))


def next_slot(slots: Column, as_of: Column) -> Column:
    """The next of the day's ``slots`` (array of hh:mm) after ``as_of``, else the first of tomorrow; null
    without slots."""
    day = as_of.cast("date")
    at = lambda d, s: F.to_timestamp_ntz(F.concat(d.cast("string"), F.lit(" "), s, F.lit(":00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    times = F.array_sort(slots)
    ahead = F.filter(F.transform(times, lambda s: at(day, s)), lambda t: t > as_of.cast("timestamp_ntz"))
    return F.coalesce(F.get(ahead, F.lit(0)), at(F.date_add(day, 1), F.get(times, F.lit(0))))


# --- deletes


@dataclass
class State:
    queries: DataFrame
    products: DataFrame
    offers: DataFrame
    opportunities: DataFrame


def without_queries(state: State, gone: DataFrame) -> State:
    """The state without the queries ``gone`` (query_id), their products and what those have; the history
    of prices is another table and stays."""
    q = gone.select("query_id").distinct()
    products = state.products.join(q, "query_id", "left_anti")
    lost = state.products.join(q, "query_id", "left_semi").select("product_id").distinct()
    return State(state.queries.join(q, "query_id", "left_anti"), products, state.offers.join(lost, "product_id", "left_anti"), state.opportunities.join(lost, "product_id", "left_anti"))


def without_stores(stores: DataFrame, offers: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores and offers without the stores ``gone`` (store_id)."""
    s = gone.select("store_id").distinct()
    return stores.join(s, "store_id", "left_anti"), offers.join(s, "store_id", "left_anti")


def with_target(products: DataFrame, changes: DataFrame) -> DataFrame:
    """Products with their query's new target (query_id, target); those with a target of their own keep it."""
    new = changes.select("query_id", F.col("target").alias("_target"), F.lit(True).alias("_changed"))
    own = F.coalesce("own_target", F.lit(False))
    return products.join(new, "query_id", "left").withColumn("target", F.when(F.col("_changed") & ~own, F.col("_target")).otherwise(F.col("target"))).drop("_target", "_changed")


def rolling_low(readings: DataFrame, days: int) -> DataFrame:
    """Each priced reading with the product's least price of the ``days`` days up to it: a sliding window."""
    span = Window.partitionBy("product_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-days * 86_400_000_000, 0)
    return readings.filter(has_price()).withColumn("low", F.min("price").over(span))
