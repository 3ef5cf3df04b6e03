"""One round: queries and captured pages in, offers, history and opportunities out.

What several steps read (listings, scores, what is accepted and kept) is written to tables between them, so that
pages are parsed and texts scored once.  Only the assignment of listings to products depends on order, and it is
a grouped map by query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.functions.extract import extract_listings
from precioscope.operators.history import change_points, current_offers
from precioscope.operators.interpret import interpret
from precioscope.operators.listings import chosen_listings
from precioscope.operators.opportunity import best_between_stores, opportunities
from precioscope.operators.resolve import assign_products
from precioscope.operators.score import price_sanity, score_texts
from precioscope.sources.staging import staged


@dataclass
class Round:
    interpreted: DataFrame
    scored: DataFrame
    assigned: DataFrame
    readings: DataFrame
    history: DataFrame
    offers: DataFrame
    opportunities: DataFrame
    between_stores: DataFrame


def run_round(queries: DataFrame, captures: DataFrame, past: DataFrame | None = None, rules: dict | None = None) -> Round:
    """``queries`` (query_id, text); ``captures`` (query_id, store_id, page_id, url, html, ts); ``past`` readings.

    Pages are read once per page_id however many queries share them.
    """
    asked = staged(interpret(queries).filter("accepted"), "asked")  # used by every later step
    pages = captures.select("page_id", "url", "html").dropDuplicates(["page_id"])
    listings = chosen_listings(extract_listings(pages, rules)).withColumnRenamed("brand", "store_brand").withColumnRenamed("category", "store_category").withColumnRenamed("url", "listing_url").withColumnRenamed("model", "store_model")
    seen = captures.select("query_id", "store_id", "page_id", "ts").join(listings, "page_id")
    scored = score_texts(seen, asked.withColumnRenamed("accepted", "query_accepted").drop("reason", "text"))
    kept = price_sanity(staged(scored.filter("accepted"), "accepted"), "query_id").filter("kept")
    kept = kept.withColumn("listing_id", F.xxhash64("page_id", "ordinal", "query_id")).withColumn("specific", (F.size("keywords") > 0) | (F.size("models") > 0) | (F.col("specificity") >= 55))
    kept = staged(kept, "kept")
    assigned = staged(assign_products(kept), "assigned")
    readings = kept.withColumn("query_id", F.col("query_id").cast("string")).join(assigned.select("query_id", "listing_id", "product_id"), ["query_id", "listing_id"])
    # The same store twice for one product in a round: the lower price counts.
    readings = readings.groupBy("product_id", "store_id", "ts").agg(F.min_by(F.struct("price", "available", "listing_url", "name"), F.struct(F.coalesce("price", F.lit(1e300)), "listing_id")).alias("r"))
    readings = readings.select("product_id", "store_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), "ts", F.col("r.price").alias("price"), F.col("r.available").alias("available"), F.col("r.listing_url").alias("url"))
    every = readings if past is None else past.unionByName(readings, allowMissingColumns=True)
    offers = current_offers(every)
    return Round(asked, scored, assigned, readings, change_points(every), offers, opportunities(every), best_between_stores(offers))
