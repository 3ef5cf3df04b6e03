"""Free-text watch queries to structured predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precioscope import lexicon as L
from precioscope.functions.text import compact, compact_normal, find_brand, find_category, find_line, literals, normalise, specs_normal, tokens_normal

MODEL = r"\b([a-z]{0,6}\d{2,6}[a-z0-9]{0,6})\b"
PAIR = r"\b([a-z]{2,8})\s+(\d{2,11}[a-z]{0,3})\b"


def _words(values: list[str]) -> Column:
    return literals(values)


def query_models(n: Column, brand: Column, specs: Column) -> Column:
    """array<struct<model, shown>>: codes with digits that are no spec, year, short number or part of the
    brand; a word and the number after it make one code (rtx 5070), which takes the number's place."""
    spec_keys = F.transform(specs, compact_normal)
    brand_words = tokens_normal(F.coalesce(brand, F.lit("")))
    brand_key = F.coalesce(compact_normal(brand), F.lit(""))
    single = F.transform(F.regexp_extract_all(n, F.lit(MODEL), F.lit(1)), lambda m: F.struct(compact_normal(m).alias("model"), m.alias("shown")))
    single = F.filter(single, lambda m: ~F.array_contains(spec_keys, m["model"]) & ~m["model"].rlike(r"^(?:\d{1,2}|(?:19|20)\d{2})$") & ~F.contains(brand_key, m["model"]))
    pairs = F.zip_with(F.regexp_extract_all(n, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(n, F.lit(PAIR), F.lit(2)), lambda w, d: F.struct(w.alias("w"), d.alias("d")))
    pairs = F.filter(pairs, lambda p: ~F.array_contains(_words(L.STOP_WORDS), p["w"]) & ~F.array_contains(brand_words, p["w"]) & ~F.array_contains(spec_keys, compact_normal(p["d"])))
    joined = F.transform(pairs, lambda p: F.struct(F.concat(p["w"], compact_normal(p["d"])).alias("model"), F.concat_ws(" ", p["w"], p["d"]).alias("shown")))
    numbers = F.transform(pairs, lambda p: compact_normal(p["d"]))
    rest = F.filter(single, lambda m: ~F.array_contains(numbers, m["model"]))
    every = F.concat(rest, joined)
    names = F.transform(every, lambda m: m["model"])
    return F.filter(every, lambda m, i: F.array_position(names, m["model"]) == i + 1)


def interpret(queries: DataFrame, text: str = "text") -> DataFrame:
    """``queries`` with one struct column per part of the interpretation.

    accepted, reason, kind (empty, brand, product, model, product+brand, category, term), brand, line,
    category, models, models_shown, specs, tokens, keywords, required (kind, value), search_terms (at
    most 3) and specificity 0-100.  A query that is only a brand is refused.
    """
    n = F.col("_n")
    q = queries.withColumn("_n", normalise(F.trim(F.col(text)))).withColumns({"_c": compact_normal(n), "tokens": tokens_normal(n), "category": find_category(n), "specs": specs_normal(n)})
    q = q.withColumn("_line", find_line(F.col("tokens"))).withColumns({"line": F.col("_line.line"), "brand": F.coalesce(find_brand(n, F.col("_c")), F.col("_line.brand"))})
    q = q.withColumn("_models", query_models(F.col("_n"), F.col("brand"), F.col("specs")))
    q = q.withColumn("models", F.transform("_models", lambda m: m["model"])).withColumn("models_shown", F.transform("_models", lambda m: m["shown"]))
    brand_words = tokens_normal(F.coalesce("brand", F.lit("")))
    alone = F.size(F.array_except("tokens", brand_words)) == 0
    has = lambda c: F.col(c).isNotNull()
    many = F.size("models") > 0
    kind = F.when(F.col("_n") == "", "empty").when(has("brand") & alone, "brand").when(many & (has("brand") | has("line")), "product").when(many, "model").when(has("category") & has("brand"), "product+brand").when(has("category"), "category").when(has("brand"), "product+brand").otherwise("term")
    q = q.withColumn("kind", kind).withColumn("accepted", ~F.col("kind").isin("empty", "brand"))
    q = q.withColumn("reason", F.when(F.col("kind") == "empty", "nothing to watch for").when(F.col("kind") == "brand", "a brand alone is too broad"))
    shown_words = F.flatten(F.transform("models_shown", tokens_normal))
    covered = F.concat(brand_words, tokens_normal(normalise(F.col("category"))), F.coalesce(F.array("line"), F.array()), F.transform("specs", normalise), F.col("models"), shown_words)

    def telling(t: Column) -> Column:
        inside = F.exists("models", lambda m: F.contains(m, t)) | F.exists("specs", lambda s: F.contains(compact(s), t))
        return ~F.array_contains(F.array_compact(covered), t) & ~t.rlike(r"^\d+$") & ~F.array_contains(_words(L.WEAK_WORDS), t) & ~inside & ((F.length(t) >= 3) | t.rlike(r"^[a-z]\d[a-z]?$"))

    q = q.withColumn("keywords", F.filter("tokens", telling))
    of = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    line = F.when(has("line"), F.array("line")).otherwise(F.array().cast("array<string>"))
    q = q.withColumn("required", F.concat(of("model", F.col("models")), of("spec", F.col("specs")), of("line", line), of("word", F.col("keywords"))))
    short = F.concat_ws(" ", F.coalesce("line", "brand"), F.array_join("keywords", " "))
    short = F.when(F.size(F.split(F.trim(short), r"\s+")) >= 2, F.trim(short))
    shown = F.when(many, F.array_join("models_shown", " "))
    terms = F.array(F.trim(F.col(text)), short, F.when(has("brand"), F.concat_ws(" ", shown, F.when(many, F.col("brand")))), shown, F.when(has("category") & has("brand"), F.concat_ws(" ", "category", "brand")), F.when(has("category") & ~has("brand"), F.col("category")), F.when(has("category") & has("brand") & (F.size("specs") > 0), F.concat_ws(" ", "category", "brand", F.get("specs", F.lit(0)))))
    terms = F.filter(F.array_compact(terms), lambda t: t != "")
    keys = F.transform(terms, compact)
    q = q.withColumn("search_terms", F.slice(F.filter(terms, lambda t, i: F.array_position(keys, compact(t)) == i + 1), 1, 3))
    one = lambda c, w: F.when(has(c), w).otherwise(0)
    upto = lambda c, most, w: F.least(F.size(c), F.lit(most)) * w
    q = q.withColumn("specificity", F.least(F.lit(100), one("category", 20) + one("brand", 20) + upto("models", 2, 22) + upto("specs", 3, 8) + upto("tokens", 6, 2) + upto("keywords", 2, 14)))
    return q.drop("_n", "_c", "_line", "_models")
