"""Relevance of listings for interpreted queries, and price sanity of what is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precioscope import lexicon as L
from precioscope.config import DEFAULTS
from precioscope.functions.text import compact, compact_normal, find_category, literals, mentions, normalise, specs_normal, trusted_brand
from precioscope.operators.history import has_price
from precioscope.operators.summary import with_upper_median
from precioscope.sources.staging import staged


def _array(values: list[str]) -> Column:
    return literals(values)


def _contains_any(text: Column, words: list[str], plain: bool = False) -> Column:
    """The first of the words that the text contains, or null."""
    return F.get(F.filter(_array(words), lambda w: F.contains(text, normalise(w) if plain else w)), F.lit(0))


def model_in_title(words: Column, model: Column) -> Column:
    """struct(found, variant): the model as a word or two joined words; a glued suffix or a variant word
    behind it makes another product unless the bare model stands in the title too."""
    spots = F.flatten(F.transform(words, lambda w, i: F.array(F.struct(w.alias("text"), (i + 1).alias("next")), F.struct(F.concat(w, F.coalesce(F.get(words, i + 1), F.lit(""))).alias("text"), (i + 2).alias("next")))))
    hits = F.filter(spots, lambda s: F.startswith(s["text"], model))

    def variant(s: Column) -> Column:
        rest = F.substring(s["text"], F.length(model) + 1, F.lit(1 << 20))
        after = F.get(words, s["next"])
        loose = F.when(F.array_contains(_array(L.LOOSE_VARIANTS), after), after)
        return F.struct((rest == "").alias("exact"), F.when(rest == "", loose).otherwise(F.when(F.array_contains(_array(L.GLUED_SUFFIXES), rest), rest)).alias("variant"))

    seen = F.filter(F.transform(hits, variant), lambda v: v["exact"] | v["variant"].isNotNull())
    bare = F.exists(seen, lambda v: v["exact"] & v["variant"].isNull())
    first = F.get(F.filter(F.transform(seen, lambda v: v["variant"]), lambda v: v.isNotNull()), F.lit(0))
    return F.struct((F.size(seen) > 0).alias("found"), F.when(~bare, first).alias("variant"))


def spec_clash(asked: Column, given: Column) -> Column:
    """The first asked spec (volts aside) whose unit the title has, but not with this value."""
    unit = lambda s: F.regexp_extract(s, r"([a-z\"]+)$", 1)
    other = lambda s: F.exists(given, lambda g: unit(g) == unit(s)) & ~F.array_contains(given, s)
    return F.get(F.filter(asked, lambda s: ~unit(s).isin("", "v") & other(s)), F.lit(0))


def score(pairs: DataFrame, base: int = DEFAULTS.accept_score, band: int = DEFAULTS.ambiguous_band) -> DataFrame:
    """``pairs`` of an interpreted query and a listing, with score, threshold, accepted, ambiguous,
    eliminated and reason.

    Columns of the query are those of ``interpret``; of the listing: name, and if present store_brand,
    store_category, gtin, mpn.  Eliminations are tried in a fixed order and the first gives the reason;
    its cheap substring tests come before the array work in one CASE.
    """
    has = lambda c, kind="string": F.col(c) if c in pairs.columns else F.lit(None).cast(kind)
    p = pairs.withColumn("_n", normalise(F.col("name"))).withColumn("_c", compact_normal(F.col("_n")))
    p = p.withColumn("_w", F.filter(F.split("_n", "[^a-z0-9]+"), lambda t: t != "")).withColumn("_specs", specs_normal(F.col("_n")))
    asked = F.array_join("tokens", " ")
    p = p.withColumn("_asked", normalise(asked)).withColumn("_query", compact(F.concat_ws(" ", "brand", F.array_join("models_shown", " "), F.array_join("specs", " "), "category")))
    accessory = _contains_any(F.col("_n"), L.ACCESSORY_WORDS, plain=True)
    p = p.withColumn("_accessory", accessory)
    wanted = lambda kind: F.transform(F.filter("required", lambda r: r["kind"] == kind), lambda r: r["value"])
    p = p.withColumn("_models", F.transform(wanted("model"), lambda m: F.struct(m.alias("model"), model_in_title(F.col("_w"), m).alias("hit"))))
    marker = F.regexp_instr(F.col("_n"), F.lit(r"\b(?:para|compativel com)\b"))
    before, behind = F.substring(F.col("_n"), F.lit(1), marker - 1), F.substring(F.col("_n"), marker, F.lit(1 << 20))
    keys = F.filter("tokens", lambda t: F.length(t) > 1)
    front, rear = F.size(F.filter(keys, lambda t: F.contains(before, t))), F.size(F.filter(keys, lambda t: F.contains(behind, t)))
    for_it = (marker > 0) & ~F.col("_asked").rlike(r"\b(?:para|compativel|acessorio|capa|suporte|gabinete)\b") & (rear >= 2) & (rear > front)
    missing = F.exists("_models", lambda m: ~m["hit"]["found"])
    other = F.exists("_models", lambda m: m["hit"]["variant"].isNotNull() & ~F.array_contains("tokens", m["hit"]["variant"]) & ~F.contains(F.col("_query"), F.concat(m["model"], m["hit"]["variant"])))
    variant = F.get(F.filter(_array(L.LOOSE_VARIANTS), lambda v: F.array_contains("tokens", v)), F.lit(0))
    plain = variant.isNotNull() & ~F.coalesce(F.array_contains("_w", variant), F.lit(False)) & F.exists("_models", lambda m: m["hit"]["variant"].isNull())
    off_line = F.exists(wanted("line"), lambda v: ~F.contains(F.col("_c"), compact(v)))
    off_word = F.exists(wanted("word"), lambda v: ~mentions(F.col("_w"), F.col("_c"), v))
    used, imported = _contains_any(F.col("_n"), L.USED_WORDS), _contains_any(F.col("_n"), L.IMPORT_WORDS)
    asked_for = F.contains(F.col("_asked"), F.trim(normalise(F.col("_accessory"))))
    p = p.withColumn(
        "reason",
        F.when(used.isNotNull(), F.concat(F.lit("used: "), used))
        .when(imported.isNotNull(), F.concat(F.lit("imported: "), imported))
        .when(F.col("_accessory").isNotNull() & ~asked_for, F.concat(F.lit("accessory: "), F.trim("_accessory")))
        .when(for_it, "made for the product")
        .when(missing, "model missing")
        .when(other, "another variant")
        .when(plain, "base model, variant asked")
        .when(off_line, "another line")
        .when(off_word, "word missing")
        .when(spec_clash(F.col("specs"), F.col("_specs")).isNotNull(), "spec differs"),
    )
    brand = compact(trusted_brand(F.col("name"), has("store_brand")))
    line_seen = F.coalesce(F.contains(F.col("_c"), compact(F.col("line"))) & F.col("line").isNotNull(), F.lit(False))
    asked_brand = compact(F.col("brand"))
    brand_points = F.when(F.col("brand").isNull(), 0).when(F.contains(brand, asked_brand), 22).when(F.contains(F.col("_c"), asked_brand) | line_seen, 18).otherwise(-12)
    category = F.coalesce(find_category(F.col("_n")), find_category(normalise(has("store_category"))))
    close = (category == F.col("category")) | F.contains(category, F.col("category")) | F.contains(F.col("category"), category)
    category_points = F.when(F.col("category").isNull(), 0).when(F.coalesce(close, F.lit(False)), 16).when(F.contains(F.col("_c"), compact(F.col("category"))), 12).when(F.col("kind") == "category", -18).otherwise(0)
    long = F.filter("tokens", lambda t: F.length(t) > 2)
    present = F.size(F.filter(long, lambda t: F.contains(F.col("_c"), compact(t))))
    cover = F.when(F.size(long) > 0, F.floor(present / F.size(long) * 34 + 0.5)).otherwise(0)
    spec_points = 8 * F.size(F.filter("specs", lambda s: F.contains(F.col("_c"), compact(s))))
    code_points = F.when(F.coalesce(has("gtin"), F.lit("")) != "", 6).when(F.coalesce(has("mpn"), F.lit("")) != "", 4).otherwise(0)
    points = 26 * F.size(wanted("model")) + 14 * F.size(wanted("word")) + brand_points + spec_points + category_points + cover + code_points
    p = p.withColumn("eliminated", F.col("reason").isNotNull())
    p = p.withColumn("score", F.when(F.col("eliminated"), 0).otherwise(F.least(F.greatest(points, F.lit(0)), F.lit(100))).cast("int"))
    p = p.withColumn("threshold", F.when(F.col("specificity") >= 55, base).when(F.col("specificity") >= 30, int(base * 0.8 + 0.5)).otherwise(int(base * 0.62 + 0.5)))
    p = p.withColumn("accepted", ~F.col("eliminated") & (F.col("score") >= F.col("threshold")))
    p = p.withColumn("ambiguous", ~F.col("eliminated") & (F.col("score") >= F.col("threshold") - band) & (F.col("score") < F.col("threshold")))
    return p.drop("_n", "_c", "_w", "_specs", "_asked", "_query", "_accessory", "_models")


def score_texts(seen: DataFrame, asked: DataFrame) -> DataFrame:
    """``score`` of ``seen`` (query_id and the columns of a listing) with the queries ``asked``; what a query
    and a text say is scored once, dealt over all tasks, however many rows have that text."""
    spark = seen.sparkSession
    parts = [c for c in ("name", "store_brand", "store_category", "gtin", "mpn") if c in seen.columns]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = seen.select("query_id", *parts).distinct().join(asked, "query_id").repartition(tasks)  # few bytes, much work
    scores = staged(score(texts), "scores").withColumnsRenamed({c: f"_{c}" for c in ("query_id", *parts)})
    return seen.join(scores, F.expr(" AND ".join(f"{c} <=> _{c}" for c in ("query_id", *parts)))).drop(*[f"_{c}" for c in ("query_id", *parts)])


def price_sanity(accepted: DataFrame, *keys: str) -> DataFrame:
    """``accepted`` (price, specificity, keywords) with median and kept: listings far from the upper median
    of their query go; those without a price stay.

    Broad queries (specificity under 30) and small groups are not judged.  The median is computed once
    per query by an aggregate and joined back, so no window holds a query's rows.
    """
    least = F.when((F.col("specificity") >= 55) | (F.size("keywords") > 0), 3).otherwise(6)
    counts = accepted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(has_price()).alias("priced"))
    stats = counts.join(with_upper_median(accepted, F.when(has_price(), F.col("price")), *keys), list(keys))
    out = accepted.join(stats, list(keys))
    wide, few = F.col("specificity") < 55, F.col("priced") < 5
    low = F.col("median") * F.when(few, 0.3).when(wide, 0.22).otherwise(0.35)
    high = F.col("median") * F.when(few, 3.6).when(wide, 3.4).otherwise(2.6)
    judged = (F.col("specificity") >= 30) & (F.col("n") >= least) & (F.col("priced") >= least)
    odd = judged & has_price() & ((F.col("price") < low) | (F.col("price") > high))
    return out.withColumn("kept", ~F.coalesce(odd, F.lit(False))).drop("n", "priced")


def sane_prices(prices: DataFrame, key: str, low: float = 0.35, high: float = 2.6, least: int = 3) -> DataFrame:
    """(key, median, kept, dropped) counts of a price band around each group's upper median."""
    priced = prices.filter(has_price())
    enough = priced.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(key)
    both = priced.join(with_upper_median(priced, F.col("price"), key).join(enough, key), key)
    odd = (F.col("price") < F.col("median") * low) | (F.col("price") > F.col("median") * high)
    return both.groupBy(key, "median").agg(F.count_if(~odd).alias("kept"), F.count_if(odd).alias("dropped"))


def admit(candidates: DataFrame, existing: DataFrame, cap: int = DEFAULTS.products_per_query) -> DataFrame:
    """New products a query may still take: the best by score while it has fewer than ``cap``."""
    have = existing.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ordinal")
    ranked = candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
    return ranked.join(have, "query_id", "left").filter(F.col("place") <= cap - F.coalesce("have", F.lit(0))).drop("have")


def quota(rows: DataFrame, order: list, per_group: int, total: int, group: str = "store_id", scope: list[str] | None = None) -> DataFrame:
    """At most ``per_group`` rows of a group and ``total`` rows in all (of a scope), in the given order.

    The group limit comes first and leaves few rows, so the second window stays small."""
    scope = scope or []
    inner = Window.partitionBy(*scope, group).orderBy(*order)
    some = rows.withColumn("_g", F.row_number().over(inner)).filter(F.col("_g") <= per_group)
    outer = Window.partitionBy(*scope).orderBy(*order) if scope else None
    if outer is None:
        return some.drop("_g").orderBy(*order).limit(total)
    return some.withColumn("_t", F.row_number().over(outer)).filter(F.col("_t") <= total).drop("_g", "_t")


def keep_most_complete(items: DataFrame, keys: list[str], fields: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One item a key: that with the most non-empty fields, the first of equals."""
    full = sum((F.coalesce(F.col(f).cast("string"), F.lit("")) != "").cast("int") for f in fields)
    rest = [c for c in items.columns if c not in keys]
    best = items.withColumn("_full", full).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_full", -F.col(ordinal))).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


