"""Data behind charts, cards and lists: domains, curves, orders, families, notices.

Everything is a column of a table; nothing is drawn here.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precioscope import lexicon as L
from precioscope.operators.history import has_price
from precioscope.sources.staging import staged

CHART_SLACK, SPARK_SLACK, HISTORY_SLACK = 0.08, 0.12, 0.12
STALE_HOURS = 2
NOTICES = 3


def chart_domain(series: DataFrame, targets: DataFrame | None = None, band: bool = True) -> DataFrame:
    """Of each product's filled daily series of two days or more: the axis, the band of all prices, the
    first day of the least price and how many of the curve's pieces are estimated.

    The axis leaves a slack of 8 % around the prices (and the target) and never begins at 0.
    """
    order = Window.partitionBy("product_id").orderBy("day")
    pieces = series.withColumn("guess", F.col("estimated") | F.lag("estimated").over(order)).withColumn("joins", F.lag("day").over(order).isNotNull())
    per = pieces.groupBy("product_id").agg(F.count(F.lit(1)).alias("days"), F.min("low").alias("band_low"), F.max("high").alias("band_high"), F.max("low").alias("top_low"), F.min_by("day", F.struct("low", "day")).alias("lowest_day"), F.count_if(F.col("joins") & F.col("guess")).alias("dashed"))
    per = per.filter("days >= 2")
    per = per.join(targets.select("product_id", "target"), "product_id", "left") if targets is not None else per.withColumn("target", F.lit(None).cast("double"))
    bottom, top = F.least("band_low", "target"), F.greatest(F.col("band_high") if band else F.col("top_low"), F.col("target"))
    slack = F.when(top > bottom, (top - bottom) * CHART_SLACK).when(top > 0, top * CHART_SLACK).otherwise(10.0)
    y_min = F.when(bottom - slack <= 0, F.when(bottom > 0, bottom * 0.5).otherwise(0.01)).otherwise(bottom - slack)
    return per.select("product_id", "days", "band_low", "band_high", "lowest_day", "dashed", y_min.alias("y_min"), (top + slack).alias("y_max"))


def sparklines(series: DataFrame) -> DataFrame:
    """Domain of a small curve with 12 % slack, and whether it ends at its least value; two values at least."""
    per = series.filter("low is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("points"), F.min("low").alias("least"), F.max("low").alias("most"), F.max_by("low", "day").alias("last"))
    slack = F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) * SPARK_SLACK).when(F.col("most") > 0, F.col("most") * SPARK_SLACK).otherwise(1.0)
    return per.filter("points >= 2").select("product_id", "points", (F.col("least") - slack).alias("y_min"), (F.col("most") + slack).alias("y_max"), (F.col("last") <= F.col("least")).alias("ends_low"))


def curve_pieces(points: DataFrame, key: str = "product_id") -> DataFrame:
    """Control points of the smooth curve through (x, y) by key: a sixth of the way between neighbours."""
    order = Window.partitionBy(key).orderBy("x")
    near = lambda c, k: F.coalesce(F.lead(c, k).over(order) if k > 0 else F.lag(c, -k).over(order), F.col(c) if k < 2 else F.lead(c, 1).over(order))
    p = points.select(key, "x", "y", *[near(c, k).alias(f"{c}{k % 10}") for c in "xy" for k in (-1, 1, 2)], F.lead("x").over(order).isNotNull().alias("joins")).filter("joins")
    ahead, back = lambda c: F.col(c) + (F.col(f"{c}1") - F.col(f"{c}9")) / 6, lambda c: F.col(f"{c}1") - (F.col(f"{c}2") - F.col(c)) / 6
    return p.select(key, F.col("x").alias("x0"), F.col("y").alias("y0"), ahead("x").alias("cx1"), ahead("y").alias("cy1"), back("x").alias("cx2"), back("y").alias("cy2"), F.col("x1").alias("x_end"), F.col("y1").alias("y_end"))


def store_history(readings: DataFrame) -> DataFrame:
    """Each store's line of a product's history, in order of time, and the axis of the product's chart."""
    priced = readings.filter(has_price())
    domain = priced.groupBy("product_id").agg(F.min("price").alias("least"), F.max("price").alias("most"))
    margin = F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) * HISTORY_SLACK).otherwise(F.col("most") * HISTORY_SLACK)
    domain = domain.select("product_id", F.greatest(F.lit(0.0), F.col("least") - margin).alias("y_min"), (F.col("most") + margin).alias("y_max"))
    lines = priced.groupBy("product_id", "store_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "price"))).alias("line"))
    return lines.join(domain, "product_id")


#: Orders of the product list; what is unknown comes last, ties by newest, then product_id.
ORDERS = ("manual", "drop", "price", "recent", "distance")


def product_list(products: DataFrame, order: str = "recent", text: str = "", query_id: str | None = None, archived: bool = False) -> DataFrame:
    """``products`` (product_id, query_id, name, brand, archived, created_at, place, and of the summary
    percent_24h, current_price, above_lowest) filtered, with their position in one of ORDERS."""
    rows = products if archived else products.filter(~F.coalesce("archived", F.lit(False)))
    rows = rows.filter(F.col("query_id") == query_id) if query_id is not None else rows
    wanted = text.strip().lower()
    if wanted:
        rows = rows.filter(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(wanted)) | F.contains(F.lower(F.coalesce("brand", F.lit(""))), F.lit(wanted)))
    first = {"manual": "place", "drop": "percent_24h", "price": "current_price", "distance": "above_lowest"}.get(order)
    keys = [*([F.col(first).asc_nulls_last()] if first else []), *([F.col("created_at").desc()] if order in ("manual", "recent") else []), F.col("product_id")]
    return numbered(rows, keys)


def numbered(rows: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``keys``, which name each row.

    Rows are dealt to ranges of the keys and stored with the range's number; a place is that inside the
    range and the rows of the ranges before, so no task orders more than one range.
    """
    dealt = staged(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.withColumn("_inside", inside).join(base, "_range").withColumn(name, F.col("_base") + F.col("_inside")).drop("_range", "_base", "_inside")


def family_cards(listed: DataFrame) -> DataFrame:
    """Queries with several products as one card: its position is that of its best product; from_price is
    the least price, of the first product that has it; at_low tells if any product is at its lowest."""
    low = (F.col("current_price") <= F.coalesce("lowest_price", F.lit(float("inf")))) & F.col("current_price").isNotNull()
    first = F.min(F.when(F.col("current_price").isNotNull(), F.struct("current_price", "position", "product_id")))
    per = listed.groupBy("query_id").agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("members"), first.alias("f"), F.bool_or(low).alias("at_low"))
    return per.select("query_id", "position", "members", F.col("f.current_price").alias("from_price"), F.col("f.product_id").alias("from_product"), F.coalesce("at_low", F.lit(False)).alias("at_low"))


def offer_price(discounted: Column | str, price: Column | str) -> Column:
    """What an offer costs: its price with discounts where it has any, else the price told."""
    return F.coalesce(F.nullif(F.col(discounted) if isinstance(discounted, str) else discounted, F.lit(0.0)), F.col(price) if isinstance(price, str) else price)


def card_offers(offers: DataFrame, summary: DataFrame, as_of: Column | str) -> DataFrame:
    """The best offer of each product by what it costs, the variation shown (24 h, else since the reading
    before) and whether the reading is over two hours old."""
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")
    cost = offer_price("discounted", "price")
    best = offers.filter(F.col("price").isNotNull()).groupBy("product_id").agg(F.min_by(F.struct("store_id", cost.alias("cost"), "price", "discounted", "ts"), F.struct(cost, "price", "seq")).alias("b"), F.max("price").alias("dearest"))
    shown = F.coalesce("percent_24h", "percent_last")
    label = F.when(F.col("percent_24h").isNotNull(), "24h").otherwise("last")
    return best.join(summary.select("product_id", "percent_24h", "percent_last"), "product_id", "left").select(
        "product_id", F.col("b.store_id").alias("store_id"), F.col("b.cost").alias("cost"), F.col("b.price").alias("told_price"), (F.coalesce("b.discounted", F.lit(0.0)) != 0).alias("has_discount"), "dearest", shown.alias("variation"), label.alias("variation_of"), (now - F.make_interval(hours=F.lit(STALE_HOURS)) > F.col("b.ts")).alias("stale")
    )


def new_notices(opportunities: DataFrame, told: DataFrame, most: int = NOTICES) -> DataFrame:
    """The unread opportunities that were not there before: the first ``most`` of the feed, and in rest
    how many more there are (the same in each row)."""
    fresh = opportunities.filter(~F.coalesce("is_read", F.lit(False))).join(told.select("opportunity_id").distinct(), "opportunity_id", "left_anti")
    total = fresh.agg(F.count(F.lit(1)).alias("total"))
    some = fresh.orderBy(F.col("ts").desc(), "opportunity_id").limit(most)
    return some.join(total).withColumn("rest", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


# --- names of families

_CUT = re.compile(r"[\s,;()\[\]\"'/\\|–—-]+")


def _words(name: str | None) -> list[tuple[str, str]]:
    """(as written, comparable) words of a name."""
    plain = lambda w: re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFD", w) if not 0x300 <= ord(c) < 0x370).lower())
    return [(w, plain(w)) for w in _CUT.split(name or "") if plain(w)]


def _common_run(names: list[list[str]]) -> list[str]:
    """The longest run of words that the first two names share, then that and the third, and so on; of
    equals the first."""
    run = names[0]
    for other in names[1:]:
        lengths, best, end = [0] * (len(other) + 1), 0, 0
        for i, word in enumerate(run):
            lengths = [0, *(lengths[j] + 1 if word == w else 0 for j, w in enumerate(other))]
            if max(lengths) > best:
                best, end = max(lengths), i + 1
        run = run[end - best : end]
    return run


def _best_spelling(word: str, seen: Counter) -> str:
    """Of the spellings of a word: capitals inside it first, then a capital at its beginning, then no
    capitals throughout, then the most frequent."""

    def worth(item: tuple[str, int]) -> tuple[int, int]:
        text, n = item
        inner = bool(re.search("[a-zà-ÿ][A-ZÀ-Þ]", text))
        return 100 * inner + 10 * bool(re.match("[A-ZÀ-Þ]", text)) - 20 * (text == text.upper()), n

    return max(seen.items(), key=worth)[0] if seen else word


def family_titles(products: DataFrame, queries: DataFrame, most_words: int = 5) -> DataFrame:
    """(query_id, title): the words that the names of a query's products have in common, in their best
    spelling, without joining words and numbers at the ends; the query's text where that is too short.

    ``products`` (query_id, ordinal, name); a query has at most a few dozen products, so each is one group.
    """
    spare = set(L.TITLE_EDGE_WORDS)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = [w for w in map(_words, frame.sort_values("ordinal")["name"]) if w]
        title = ""
        if names:
            common = _common_run([[k for _, k in n] for n in names])
            loose = lambda k: k in spare or k.isdigit()
            while common and loose(common[0]):
                common = common[1:]
            while common and loose(common[-1]):
                common = common[:-1]
            spellings = {k: Counter(t for n in names for t, x in n if x == k) for k in common[:most_words]}
            title = " ".join(k if k in spare else _best_spelling(k, spellings[k]) for k in common[:most_words])
        return pd.DataFrame({"query_id": [frame["query_id"].iloc[0]], "common": [title]})

    named = products.select(F.col("query_id").cast("string"), "ordinal", "name").groupBy("query_id").applyInPandas(run, "query_id string, common string")
    text = F.trim(F.coalesce("text", F.lit("")))
    text = F.when(text == "", "Produtos").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))
    return named.join(queries.select(F.col("query_id").cast("string"), "text"), "query_id", "left").select("query_id", F.when(F.length("common") >= 4, F.col("common")).otherwise(text).alias("title"))


def short_day(day: Column) -> Column:
    """05/ago."""
    months = F.array(*map(F.lit, L.SHORT_MONTHS))
    return F.concat(F.date_format(day, "dd"), F.lit("/"), F.element_at(months, F.month(day)))
