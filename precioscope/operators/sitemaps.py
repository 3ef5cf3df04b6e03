"""Addresses that stores publish in their sitemaps, read from captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precioscope.functions.policy import sitemap_children, sitemap_urls

#: Where a sitemap may be, in order.
PLACES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml"]
VALID_HOURS = 24


def sitemap_places(origin: Column) -> Column:
    base = F.regexp_replace(origin, "/$", "")
    return F.array(*[F.concat(base, F.lit(p)) for p in PLACES])


def read_sitemaps(stores: DataFrame, responses: DataFrame) -> DataFrame:
    """(store_id, place, ordinal, url): what each store's sitemap names, in its order.

    ``stores`` (store_id, origin), ``responses`` (url, ok, body), one of an address.  The first place
    that gives any address counts; an index is followed one level down, into its first five sitemaps.
    A place that fails, names nothing, or is an index of sitemaps that all fail is passed over.
    Bodies meet stores by address only, so nothing but the named sitemaps is parsed.
    """
    served = responses.filter("ok").select(F.col("url").alias("_url"), "body")
    places = stores.select("store_id", F.posexplode(sitemap_places(F.col("origin"))).alias("place", "_url"))
    heads = places.join(served, "_url").filter(F.contains("body", F.lit("<loc>")))
    index = F.contains(F.lower("body"), F.lit("<sitemapindex"))
    plain = heads.filter(~index).select("store_id", "place", F.lit(0).alias("child"), F.posexplode(sitemap_urls(F.col("body"))).alias("at", "url"))
    children = heads.filter(index).select("store_id", "place", F.posexplode(sitemap_children(F.col("body"))).alias("child", "_url"))
    below = children.join(served, "_url").select("store_id", "place", "child", F.posexplode(sitemap_urls(F.col("body"))).alias("at", "url"))
    every = plain.unionByName(below)
    first = every.groupBy("store_id").agg(F.min("place").alias("place"))
    return every.join(first, ["store_id", "place"]).select("store_id", "place", (F.col("child").cast("long") * (1 << 32) + F.col("at")).alias("ordinal"), "url")


def stale_sitemaps(stores: DataFrame, read: DataFrame, as_of: Column, hours: int = VALID_HOURS) -> DataFrame:
    """Stores whose sitemap was never read or a day ago and more; ``read`` (store_id, read_at)."""
    last = read.groupBy("store_id").agg(F.max("read_at").alias("_at"))
    fresh = last.filter(F.col("_at") > as_of - F.make_interval(hours=F.lit(hours))).select("store_id")
    return stores.join(fresh, "store_id", "left_anti")
