"""Choice among extraction strategies and clean listings of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precioscope.operators.history import has_price
from precioscope.operators.score import keep_most_complete
from precioscope.sources.staging import staged

# Trust in each strategy, in the order that ties follow.
CONFIDENCE = {"jsonld": 1.35, "state": 1.0, "microdata": 1.25, "selectors": 1.15, "blocks": 0.95}


def dedupe(listings: DataFrame) -> DataFrame:
    """One listing per page, strategy, address and first 80 letters of the name: the most complete."""
    keyed = listings.withColumn("_k", F.concat_ws("|", F.coalesce("url", F.lit("")), F.substring(F.lower("name"), 1, 80)))
    best = keep_most_complete(keyed, ["page_id", "strategy", "_k"], ["price", "url", "image", "brand", "gtin", "sku"])
    return best.filter(F.length("name") > 4).select(*listings.columns)


def strategy_points(listings: DataFrame, by: str = "page_id") -> DataFrame:
    """Per page and strategy: items, priced, usable, quality and points.

    Quality falls with missing links, repeated prices and repeated names.  Points count usable listings
    (priced with a link, or priced where no strategy has links) by quality and trust.
    """
    url, name = F.coalesce("url", F.lit("")) != "", F.lower("name")
    per = listings.groupBy(by, "strategy").agg(F.count(F.lit(1)).alias("items"), F.count_if(has_price()).alias("priced"), F.count_if(has_price() & url).alias("usable"), F.count_if(url).alias("links"), F.count_distinct(F.when(has_price(), F.round(F.col("price") * 100))).alias("prices"), F.count_distinct(name).alias("names"))
    quality = (0.45 + 0.55 * (F.col("links") / F.col("items"))) * (0.25 + 0.75 * F.least(F.lit(1.0), F.coalesce(F.try_divide("prices", "priced"), F.lit(0.0)) * 1.6)) * (0.6 + 0.4 * (F.col("names") / F.col("items")))
    any_link = per.groupBy(by).agg(F.max("usable").alias("_any"))
    trust = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("strategy"))
    base = F.when(F.col("_any") > 0, F.col("usable")).otherwise(F.col("priced"))
    return per.withColumn("quality", quality).join(any_link, by).withColumn("points", base * F.col("quality") * trust).drop("_any")


def choose_strategy(points: DataFrame, by: str = "page_id") -> DataFrame:
    """The strategy with the most points; the earlier of equals; where none has points, the first with items."""
    place = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(CONFIDENCE) for x in (s, -i)]), F.col("strategy"))
    return points.groupBy(by).agg(F.max_by("strategy", F.struct("points", place)).alias("strategy"))


def chosen_listings(listings: DataFrame) -> DataFrame:
    """Deduplicated listings of each page's chosen strategy; only priced ones where there are any."""
    clean = staged(dedupe(listings), "listings")  # read several times, and pages are parsed once
    best = choose_strategy(strategy_points(clean))
    some = clean.groupBy("page_id", "strategy").agg(F.count_if(has_price()).alias("_priced"))
    out = clean.join(best, ["page_id", "strategy"]).join(some, ["page_id", "strategy"])
    return out.filter((F.col("_priced") == 0) | has_price()).drop("_priced")
