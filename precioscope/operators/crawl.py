"""Decisions about stores as columns: how to read them, whether what came back is a result, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precioscope.functions.policy import host_of
from precioscope.functions.text import compact, fold_accents
from precioscope.operators.history import has_price

#: Trust in a strategy when search addresses are compared.
SEARCH_TRUST = {"jsonld": 1.6, "microdata": 1.4, "selectors": 1.2, "state": 1.0, "blocks": 0.9}
TYPED_SHARE = 0.2
CHEAP_ITEMS = 3


def fallback(refusal: Column, status: Column, browser_allowed: Column, respects: Column) -> Column:
    """What follows a plain request: take it, report a refusal, a wrong address or the failure, or open a
    browser.  ``refusal`` is that of functions.policy; a refusal is never worked around unless ``respects`` is false."""
    return (
        F.when(refusal.isin("served", "shell"), "take")
        .when(~browser_allowed, "report")
        .when((refusal == "blocked") & respects, "refused")
        .when((status == 404) & (refusal != "blocked"), "wrong_address")
        .otherwise("browser")
    )


def access_path(stores: DataFrame) -> Column:
    """How a store is read, in order: not at all where robots rules forbid it, plainly where no browser is
    needed or a plain request gave enough items again, from its sitemap, by typing, else by browser.

    Columns: robots_allow, typed, needs_browser, plain_items (of a new plain try, null: not due), sitemap.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    typed = yes("typed")
    return (
        F.when(~F.coalesce(F.col("robots_allow"), F.lit(True)) & ~typed, "forbidden")
        .when(~yes("needs_browser") & ~typed, "plain")
        .when(~typed & (F.coalesce(F.col("plain_items"), F.lit(0)) >= CHEAP_ITEMS), "plain_again")
        .when(yes("sitemap"), "sitemap")
        .when(typed, "typed")
        .otherwise("browser")
    )


def relevance(items: DataFrame, keys: list[str], terms: Column, name: Column) -> DataFrame:
    """Per group: items, those whose compact name holds any of ``terms`` (compact, over 2 letters), and
    their share, 1 where there is nothing to look for."""
    wanted = F.filter(F.transform(terms, compact), lambda t: F.length(t) > 2)
    c = compact(name)
    hit = F.exists(wanted, lambda t: F.contains(c, t))
    per = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("related"), F.max(F.size(wanted)).alias("_terms"))
    return per.select(*keys, "items", "related", F.when(F.col("_terms") == 0, 1.0).otherwise(F.col("related") / F.col("items")).alias("relevance"))


def typed_result_counts(relevances: DataFrame, least: float = TYPED_SHARE) -> DataFrame:
    """Is a typed search's result one (at least a fifth of it related), or the store's shop window?"""
    return relevances.withColumn("is_result", F.col("relevance") >= least)


def search_candidates(tried: DataFrame) -> DataFrame:
    """Points of each search address tried: usable items by relevance and trust in the strategy; none
    where the store sent back its home page.

    ``tried``: store_id, pattern, ordinal, strategy, items, priced, linked, with_code, relevance, home.
    """
    trust = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEARCH_TRUST.items() for x in kv]), F.col("strategy")), F.lit(1.0))
    base = F.when(F.col("linked") > 0, F.col("linked")).otherwise(F.col("priced"))
    return tried.withColumn("points", F.when(F.col("home"), 0.0).otherwise(base * F.col("relevance") * trust))


def diagnose(candidates: DataFrame, robots_forbid: DataFrame | None = None) -> DataFrame:
    """The best search address of each store (the first of equals) with its verdict: compatible (3 priced
    items or more from structured data, no robots rule against it), partial, or incompatible (no points)."""
    rest = [c for c in candidates.columns if c != "store_id"]
    best = candidates.groupBy("store_id").agg(F.max_by(F.struct(*rest), F.struct("points", -F.col("ordinal"))).alias("r")).select("store_id", *[F.col("r").getField(c).alias(c) for c in rest])
    if robots_forbid is not None:
        best = best.join(robots_forbid.select("store_id", F.lit(True).alias("forbidden")).distinct(), "store_id", "left")
    else:
        best = best.withColumn("forbidden", F.lit(None).cast("boolean"))
    forbidden = F.coalesce("forbidden", F.lit(False))
    structured = F.col("strategy").isin("jsonld", "microdata", "state")
    verdict = F.when(F.col("points") <= 0, "incompatible").when((F.col("priced") >= 3) & structured & ~forbidden, "compatible").otherwise("partial")
    limits = F.array_compact(F.array(F.when(~structured, "no_structured_data"), F.when(F.col("with_code") == 0, "no_product_codes"), F.when(F.col("priced") < F.col("items") * 0.6, "few_prices"), F.when(forbidden, "robots"), F.when(F.col("strategy") == "blocks", "layout_only")))
    return best.select("store_id", "pattern", "points", verdict.alias("verdict"), F.array_join(limits, ",").alias("limits"))


def entered_store(entry: Column) -> Column:
    """struct(origin, host) of what a person typed as a store's address, null if it is none."""
    s = F.trim(F.coalesce(entry, F.lit("")))
    s = F.when(s.rlike(r"(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))
    host = F.lower(F.regexp_extract(s, r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#\s]+)(?::\d+)?(?:[/?#]|$)", 1))
    port = F.regexp_extract(s, r"(?i)^https?://(?:[^/@?#]*@)?[^/:?#\s]+(:\d+)", 1)
    origin = F.concat(F.lower(F.regexp_extract(s, r"(?i)^(https?://)", 1)), host, port)
    return F.when(F.contains(host, F.lit(".")), F.struct(origin.alias("origin"), host.alias("host")))


def store_name(site_name: Column, title: Column, host: Column) -> Column:
    """A store's name: what its page says, else the head of its title if that is short, else of its host."""
    head = F.trim(F.get(F.split(F.coalesce(title, F.lit("")), r"[|\-–—:]"), F.lit(0)))
    plain = F.get(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), F.lit(0))
    return F.coalesce(F.nullif(F.trim(site_name), F.lit("")), F.when((head != "") & (F.length(head) < 40), head), F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain))))


def library_search(library: DataFrame, text: str, registered: DataFrame | None = None) -> DataFrame:
    """Known stores whose name or host holds the text, accents and case aside; is_registered where asked."""
    plain = lambda c: fold_accents(F.lower(F.coalesce(c, F.lit(""))))
    wanted = plain(F.lit(text.strip()))
    out = library.filter(F.contains(plain(F.col("name")), wanted) | F.contains(plain(F.col("host")), wanted))
    if registered is None:
        return out
    homes = registered.select(host_of(F.col("origin")).alias("_host"), F.lit(True).alias("is_registered")).distinct()
    return out.withColumn("_host", F.regexp_replace(F.lower("host"), r"^www\.", "")).join(homes, "_host", "left").withColumn("is_registered", F.coalesce("is_registered", F.lit(False))).drop("_host")


def needs_disclosure(stores: DataFrame) -> DataFrame:
    """One row: does any store earn by links (column usable), so that it must be said?"""
    return stores.agg(F.coalesce(F.bool_or("usable"), F.lit(False)).alias("disclose"), F.count_if("usable").alias("stores"))


def paged(rows: DataFrame, key: str, size: int = 1000, per_task: int = 1_000_000) -> DataFrame:
    """The bounds of pages of ``size`` rows in order of a unique whole-number key: page, first, last, rows.

    These are the bounds that a partitioned read of a database table takes.  Places come from counts of
    equal ranges of the key, so no task numbers more than the rows of one range.
    """
    k = rows.select(F.col(key).cast("long").alias("k"))
    bounds = k.agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n")).first()
    ranges = max(1, -(-bounds["n"] // per_task))
    width = max(1, -(-((bounds["high"] or 0) - (bounds["low"] or 0) + 1) // ranges))
    dealt = k.withColumn("range", F.floor((F.col("k") - (bounds["low"] or 0)) / width).cast("long"))
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = dealt.join(base, "range").withColumn("place", F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy("k")) - 1)
    return numbered.groupBy(F.floor(F.col("place") / size).cast("long").alias("page")).agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("rows"))


def cheap_enough(listings: DataFrame, by: str = "store_id") -> DataFrame:
    """Stores that a plain request serves again: at least three priced items with a link."""
    return listings.groupBy(by).agg(F.count_if(has_price() & (F.coalesce("url", F.lit("")) != "")).alias("plain_items")).withColumn("plain_again", F.col("plain_items") >= CHEAP_ITEMS)
