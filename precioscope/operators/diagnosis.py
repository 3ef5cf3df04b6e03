"""Where a store's search may be, in which order addresses are tried, and what the trials say of it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from precioscope.functions.dom import Node, absolute, parse
from precioscope.functions.policy import encode_component, host_of
from precioscope.operators.crawl import diagnose, search_candidates

# Search paths tried in every store, in order; names and hints of a search field.
SEARCH_PATHS = [
    "/busca?q={t}",
    "/busca/{t}",
    "/search?q={t}",
    "/s?k={t}",
    "/?s={t}",
    "/pesquisa?t={t}",
    "/busca?termo={t}",
    "/catalogsearch/result/?q={t}",
    "/{t}?map=ft",
    "/search/?q={t}",
    "/produtos?busca={t}",
    "/loja/busca.php?loja=&palavra_busca={t}",
]
FIELD_NAME = r"(?i)^(q|s|k|kw|query)$"
FIELD_HINT = r"(?i)(busca|search|termo|term|keyword|palavra|pesquis|query)"
MOST_ADDRESSES = 10
ENOUGH_TRIED = 8
RELATED = 0.2
FIELD = StructType([StructField(n, StringType()) for n in ("kind", "name", "value", "hints")])
FORM = ArrayType(StructType([StructField("action", StringType()), StructField("method", StringType()), StructField("fields", ArrayType(FIELD))]))


def _fields(form: Node) -> list[dict]:
    hints = lambda n: " ".join(n.get(a) for a in ("name", "id", "placeholder", "class"))
    return [{"kind": (n.get("type") or "text").lower(), "name": n.get("name"), "value": n.get("value"), "hints": hints(n)} for n in form.walk() if n.tag == "input" and n.get("name")]


@F.pandas_udf(FORM)
def _forms(html: pd.Series, origin: pd.Series) -> pd.Series:
    def one(text: str | None, base: str | None) -> list[dict]:
        if not text or "<form" not in text.lower():
            return []
        forms = [n for n in parse(text).walk() if n.tag == "form"]
        return [{"action": absolute(n.get("action") or "/", base), "method": (n.get("method") or "get").lower(), "fields": _fields(n)} for n in forms]

    return pd.Series([one(t, b) for t, b in zip(html, origin, strict=True)])


def form_searches(html: Column, origin: Column) -> Column:
    """Search address patterns, ``{t}`` for the term, that a page's own forms give: of every form that
    is sent by GET each field that looks like a search box, with the form's hidden fields.

    Only the document tree is Python; which field searches and what address comes of it are expressions.
    """

    def patterns(form: Column) -> Column:
        hidden = F.filter(form["fields"], lambda f: (f["kind"] == "hidden") & (f["value"] != ""))
        rest = F.transform(hidden, lambda f: F.concat(encode_component(f["name"]), F.lit("="), encode_component(f["value"])))
        searches = F.filter(form["fields"], lambda f: (f["kind"] == "search") | f["name"].rlike(FIELD_NAME) | f["hints"].rlike(FIELD_HINT))
        link = F.when(F.contains(form["action"], F.lit("?")), "&").otherwise("?")
        return F.transform(searches, lambda f: F.concat(form["action"], link, F.array_join(F.concat(F.array(F.concat(encode_component(f["name"]), F.lit("={t}"))), rest), "&")))

    read = F.filter(_forms(html, origin), lambda f: (f["method"] == "get") & f["action"].isNotNull())
    return F.array_distinct(F.flatten(F.transform(read, patterns)))


def search_address(pattern: Column, origin: Column, term: Column) -> Column:
    """The address that a pattern, whole or a path of ``origin``, gives for a term (its first ``{t}`` only)."""
    at = F.instr(pattern, "{t}")
    filled = F.when(at > 0, F.concat(F.substring(pattern, F.lit(1), at - 1), encode_component(term), F.substring(pattern, at + 3, F.length(pattern)))).otherwise(pattern)
    return F.when(F.startswith(pattern, F.lit("http")), filled).otherwise(F.concat(F.regexp_replace(origin, "/$", ""), filled))


def search_patterns(stores: DataFrame, library: DataFrame) -> DataFrame:
    """(store_id, ordinal, pattern, source, worth_browser): the search addresses to try in each store, at most ten.

    ``stores`` (store_id, origin, html of the home page or null, told: a pattern someone gave, or null),
    ``library`` (ordinal, host, search_url with ``{q}``): of several entries of one host, ``www.`` aside,
    the first.  What was told comes first, then the library's, the forms', and the usual paths; of equal
    patterns the first stays.  ``worth_browser`` marks those that are worth a browser if a plain answer is a shell.
    """
    bare = lambda host: F.regexp_replace(F.lower(host), r"^www\.", "")
    known = library.filter(F.coalesce("search_url", F.lit("")) != "").groupBy(bare(F.col("host")).alias("_host")).agg(F.min_by("search_url", "ordinal").alias("_url"))
    rows = stores.withColumn("_host", host_of(F.col("origin"))).join(known, "_host", "left")
    origin = F.regexp_replace("origin", "/$", "")
    rows = rows.select("store_id", "told", F.replace("_url", F.lit("{q}"), F.lit("{t}")).alias("_known"), form_searches(F.col("html"), F.col("origin")).alias("_forms"), F.transform(F.array(*map(F.lit, SEARCH_PATHS)), lambda p: F.concat(origin, p)).alias("_usual"))
    every = F.array_distinct(F.array_compact(F.concat(F.array("told", "_known"), "_forms", "_usual")))
    rows = rows.withColumn("_first", F.size("_forms") + F.when(F.col("_known").isNotNull(), 2).otherwise(1))
    listed = rows.select("*", F.posexplode(F.slice(every, 1, MOST_ADDRESSES)).alias("_at", "pattern"))
    source = F.when(F.col("pattern") == F.col("told"), "told").when(F.col("pattern") == F.col("_known"), "library").when(F.array_contains("_forms", F.col("pattern")), "form").otherwise("usual")
    return listed.select("store_id", (F.col("_at") + 1).alias("ordinal"), "pattern", source.alias("source"), (F.col("_at") < F.col("_first")).alias("worth_browser"))


def trials(tried: DataFrame) -> DataFrame:
    """The trials that are made, in order of ordinal, with points and usable.

    ``tried``: as for ``search_candidates``, with answered, blocked and structured.  Trying ends at a
    usable address that is good (8 priced items of structured data, over 0.6 related), or that is the
    eighth tried or later.  Usable: answered with items, not the home page, a fifth of them related.
    A store has at most ten rows, so the window is small.
    """
    usable = F.col("answered") & ~F.col("blocked") & (F.col("items") > 0) & ~F.col("home") & (F.col("relevance") >= RELATED)
    good = (F.col("priced") >= 8) & F.col("structured") & (F.col("relevance") > 0.6)
    rows = search_candidates(tried).withColumn("usable", F.coalesce(usable, F.lit(False)))
    ends = F.min(F.when(F.col("usable") & (good | (F.col("ordinal") >= ENOUGH_TRIED)), F.col("ordinal"))).over(Window.partitionBy("store_id"))
    return rows.withColumn("_ends", ends).filter(F.col("_ends").isNull() | (F.col("ordinal") <= F.col("_ends"))).drop("_ends")


def diagnose_trials(tried: DataFrame, robots_forbid: DataFrame | None = None) -> DataFrame:
    """(store_id, pattern, points, verdict, limits, trials): the verdict of each store that was tried; one
    without a usable address is incompatible, because its search is blocked or was not found."""
    made = trials(tried)
    counts = made.groupBy("store_id").agg(F.count(F.lit(1)).alias("trials"), F.count_if("blocked").alias("refused"))
    found = diagnose(made.filter("usable"), robots_forbid)
    why = F.when(F.col("refused") > 0, "search_blocked").otherwise("search_not_found")
    out = counts.join(found, "store_id", "left")
    return out.select("store_id", "pattern", F.coalesce("points", F.lit(0.0)).alias("points"), F.coalesce("verdict", F.lit("incompatible")).alias("verdict"), F.coalesce("limits", why).alias("limits"), "trials")
