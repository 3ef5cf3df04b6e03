"""A round that knows the rounds before it: state and captured pages in, the next state out.

State is two tables, products and offers, beside the history of readings.  Every step is an operator of
its own; the plan is lazy but for the assignment's input, which several results read and is staged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precioscope.functions.extract import extract_listings
from precioscope.operators import lifecycle as Y
from precioscope.operators.history import change_points, is_available
from precioscope.operators.interpret import interpret
from precioscope.operators.listings import chosen_listings
from precioscope.operators.opportunity import best_between_stores, opportunities
from precioscope.operators.resolve import assign_round, revalidate
from precioscope.operators.score import price_sanity, score, score_texts
from precioscope.sources.staging import staged

PRODUCTS = "query_id string, product_id string, identity_key string, name string, brand string, gtin string, archived boolean, created_at timestamp"
OFFERS = "product_id string, store_id string, price double, previous_price double, seq long, ts timestamp, title string, available boolean, absent_rounds int, manual boolean"
READINGS = "product_id string, store_id string, seq long, ts timestamp, price double, available boolean"


@dataclass
class WatchState:
    products: DataFrame
    offers: DataFrame
    readings: DataFrame


@dataclass
class WatchRound:
    state: WatchState
    assigned: DataFrame
    vanished: DataFrame
    opportunities: DataFrame
    between_stores: DataFrame


def empty_state(spark: SparkSession) -> WatchState:
    return WatchState(*[spark.createDataFrame([], s) for s in (PRODUCTS, OFFERS, READINGS)])


def _scored_products(products: DataFrame, asked: DataFrame) -> DataFrame:
    """What the queries' rules say of the products so far, by their names."""
    seen = products.select("query_id", "product_id", "name", F.nullif("brand", F.lit("")).alias("store_brand"), F.lit(None).cast("string").alias("store_category"), "gtin", F.lit(None).cast("string").alias("mpn"), F.lit(None).cast("double").alias("price"))
    return score(seen.join(asked, "query_id"))


def run_watch(state: WatchState, queries: DataFrame, captures: DataFrame, visits: DataFrame | None = None, links: DataFrame | None = None, stores: DataFrame | None = None, targets: DataFrame | None = None) -> WatchRound:
    """``queries`` (query_id, text), ``captures`` (query_id, store_id, page_id, url, html, ts).

    Products whose names the rules now eliminate are archived first.  Listings are read, scored, held
    against the prices of their query and given to products (``resolve.assign_round``).  Offers of stores that were
    read but did not show them are settled by ``visits`` (product_id, store_id, price, available).  ``links``
    (product_id, url) with ``stores`` (store_id, origin) add offers by hand, priced by ``visits`` of that url.
    """
    asked = interpret(queries.withColumn("query_id", F.col("query_id").cast("string"))).filter("accepted").withColumnRenamed("accepted", "query_accepted").drop("reason", "text")
    asked = staged(asked, "asked")
    products = revalidate(state.products, _scored_products(state.products, asked)).drop("archive_reason")
    products = staged(products, "products")
    pages = captures.select("page_id", "url", "html").dropDuplicates(["page_id"])
    listings = chosen_listings(extract_listings(pages)).withColumnRenamed("brand", "store_brand").withColumnRenamed("category", "store_category").withColumnRenamed("url", "listing_url").withColumnRenamed("model", "store_model")
    seen = captures.select(F.col("query_id").cast("string").alias("query_id"), F.col("store_id").cast("string").alias("store_id"), "page_id", F.col("ts").cast("timestamp").alias("ts")).join(listings, "page_id")
    kept = price_sanity(staged(score_texts(seen, asked).filter("accepted"), "accepted"), "query_id").filter("kept")
    kept = kept.withColumn("listing_id", F.xxhash64("page_id", "ordinal", "query_id", "store_id")).withColumn("specific", (F.size("keywords") > 0) | (F.size("models") > 0) | (F.col("specificity") >= 55)).withColumn("seq", F.unix_micros("ts"))
    kept = staged(kept.select("query_id", "listing_id", "store_id", "name", F.col("price").cast("double").alias("price"), "available", "score", "ordinal", "specific", "store_brand", "gtin", "mpn", "seq", "ts"), "kept")
    assigned = staged(assign_round(kept, products, state.offers), "assigned")
    taken = kept.join(assigned, ["query_id", "listing_id"])
    made = taken.filter("is_new").select("query_id", "product_id", "identity_key", "name", F.coalesce("store_brand", F.lit("")).alias("brand"), F.coalesce("gtin", F.lit("")).alias("gtin"), F.lit(False).alias("archived"), F.col("ts").alias("created_at"))
    products = products.unionByName(made, allowMissingColumns=True)
    updated, readings = Y.offers_after(taken, state.offers)
    updated = updated.join(state.offers.select("product_id", "store_id", "manual"), ["product_id", "store_id"], "left").withColumn("manual", F.coalesce("manual", F.lit(False)))
    now = F.lit(captures.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]).cast("long")  # the round's clock
    spark = queries.sparkSession
    visits = spark.createDataFrame([], "product_id string, store_id string, url string, price double, available boolean") if visits is None else visits
    read_stores = captures.select(F.lit(None).cast("string").alias("product_id"), F.col("store_id").cast("string").alias("store_id")).distinct()
    shown = readings.select("product_id", "store_id").unionByName(read_stores)
    gone = Y.settle_vanished(updated, shown, visits, now, F.timestamp_micros(now))
    gone = staged(gone, "gone")
    updated = _replaced(updated, gone)
    again = gone.select("product_id", "store_id", "seq", F.col("ts").cast("timestamp").alias("ts"), F.col("history_price").alias("price"), "available")
    readings = readings.select("product_id", "store_id", "seq", "ts", "price", "available").unionByName(again)
    if links is not None:
        given = Y.manual_offers(links, stores, visits.select("product_id", "url", "price", "available").filter("url is not null")).filter("result = 'ok'")
        by_hand = given.select("product_id", "store_id", "price", F.lit(None).cast("double").alias("previous_price"), now.alias("seq"), F.timestamp_micros(now).alias("ts"), F.lit(None).cast("string").alias("title"), "available", F.lit(0).alias("absent_rounds"), "manual")
        updated = updated.join(by_hand.select("product_id", "store_id"), ["product_id", "store_id"], "left_anti").unionByName(by_hand)
        readings = readings.unionByName(by_hand.select("product_id", "store_id", "seq", "ts", "price", "available"))
    readings = staged(readings, "readings")
    every = state.readings.unionByName(readings)
    told = opportunities(every, targets).join(readings.select("product_id", "store_id", "seq").distinct(), ["product_id", "store_id", "seq"], "left_semi")
    return WatchRound(WatchState(products, updated, change_points(every).select("product_id", "store_id", "seq", "ts", "price", "available")), assigned, gone, told, best_between_stores(updated.filter(is_available())))


def _replaced(offers: DataFrame, changes: DataFrame) -> DataFrame:
    """Offers with price, availability and absence of ``changes`` where these have the offer."""
    c = changes.select("product_id", "store_id", F.col("price").alias("_price"), F.col("available").alias("_available"), F.col("absent_rounds").alias("_absent"), F.lit(True).alias("_changed"))
    both = offers.join(c, ["product_id", "store_id"], "left")
    pick = lambda new, old: F.when(F.col("_changed"), F.col(new)).otherwise(F.col(old)).alias(old)
    return both.select("product_id", "store_id", pick("_price", "price"), "previous_price", "seq", "ts", "title", pick("_available", "available"), pick("_absent", "absent_rounds"), "manual")
