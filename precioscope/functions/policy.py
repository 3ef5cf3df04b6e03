"""Crawl policy as column expressions: refusals, robots rules, sitemaps, affiliate links, pacing."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from precioscope.functions.text import compact

SHELL_BYTES = 8000
# Marks of a refusal page.
BLOCK_SIGNS = [
    "captcha", "are you a robot", "não é um robô", "nao e um robo", "cf-browser-verification", "cf_chl",
    "checking your browser", "verificando seu navegador", "access denied", "acesso negado", "request blocked",
    "perimeterx", "px-captcha", "incapsula", "unusual traffic", "tráfego incomum", "bot detection", "akamai reference",
]


def looks_blocked(status: Column, html: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 6000))
    return F.coalesce(status.isin(403, 429, 503), F.lit(False)) | head.rlike("|".join(BLOCK_SIGNS))


def refusal(status: Column, html: Column) -> Column:
    """none, blocked, shell (a success with next to nothing), failed, or served."""
    ok = status.between(200, 299)
    return F.when(status.isNull(), "none").when(looks_blocked(status, html), "blocked").when(ok & (F.length(F.coalesce(html, F.lit(""))) < SHELL_BYTES), "shell").when(~ok, "failed").otherwise("served")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, kind, path) rules for all agents of ``files`` (host, body); kind: allow, disallow, crawl-delay."""
    lines = files.select("host", F.posexplode(F.split("body", "\r?\n")).alias("place", "line"))
    lines = lines.withColumn("line", F.lower(F.trim("line"))).withColumn("kind", F.trim(F.substring_index("line", ":", 1))).withColumn("path", F.trim(F.regexp_replace("line", "^[^:]*:", "")))
    past = Window.partitionBy("host").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when((F.col("kind") == "user-agent") & F.contains("line", F.lit(":")), F.col("path")), ignorenulls=True).over(past)
    return lines.withColumn("agent", agent).filter("agent = '*' and kind in ('allow', 'disallow', 'crawl-delay') and path <> ''").select("host", "kind", "path")


def rule_strength(path: Column, rule: Column) -> Column:
    """Length of a rule that matches the path from its beginning (* any run, $ the end), else 0."""
    quoted = F.regexp_replace(rule, r"([.+?^{}()|\[\]\\$])", r"\\$1")
    body = F.replace(quoted, F.lit("*"), F.lit(".*"))
    body = F.regexp_replace(body, r"\\\$$", r"\$")
    return F.when(F.regexp_like(path, F.concat(F.lit("^"), body)), F.length(rule)).otherwise(0)


def robots_allows(path: Column, disallow: Column, allow: Column) -> Column:
    """The longer match decides, ties allow, silence allows."""
    most = lambda rules: F.coalesce(F.array_max(F.transform(rules, lambda r: rule_strength(path, r))), F.lit(0))
    return most(disallow) <= most(allow)


def forbids_search(rules: DataFrame) -> DataFrame:
    """(host, forbids_search) of robots rules (host, kind, path): is everything, or a search path, disallowed?"""
    hit = (F.col("kind") == "disallow") & ((F.col("path") == "/") | F.col("path").rlike(r"^/(?:busca|search|s\b|pesquisa)"))
    return rules.groupBy("host").agg(F.bool_or(hit).alias("forbids_search"))


def sitemap_children(xml: Column, most: int = 5) -> Column:
    """The sitemaps that an index names, the first ``most``; none if it is no index."""
    return F.when(F.contains(F.lower(xml), F.lit("<sitemapindex")), F.slice(sitemap_urls(xml), 1, most)).otherwise(F.array().cast("array<string>"))


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))


def url_score(url: Column, terms: Column) -> Column:
    """1000 less the compact address's length (900 at most) if it holds every term, else 0."""
    c = compact(F.coalesce(F.try_url_decode(url), url))
    return F.when(F.forall(terms, lambda t: F.contains(c, t)), 1000 - F.least(F.length(c), F.lit(900))).otherwise(0)


def encode_component(x: Column) -> Column:
    """As browsers encode a component: spaces %20, ! ' ( ) ~ bare."""
    s = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for coded, bare in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        s = F.replace(s, F.lit(coded), F.lit(bare))
    return s


def search_url(template: Column, origin: Column, term: Column) -> Column:
    return F.when(F.contains(template, F.lit("{q}")), F.replace(template, F.lit("{q}"), encode_component(term))).otherwise(F.concat(F.regexp_replace(origin, "/$", ""), F.lit("/busca?q="), encode_component(term)))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


@F.pandas_udf(StringType())
def _set_parameter(url: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
    def one(u, k, v):
        try:
            parts = urlsplit(u)
            if not parts.scheme or not parts.netloc:
                return u
            pairs, done = [], False
            for a, b in parse_qsl(parts.query, keep_blank_values=True):
                if a != k:
                    pairs.append((a, b))
                elif not done:
                    pairs.append((k, v))
                    done = True
            return urlunsplit((parts.scheme, parts.netloc, parts.path or "/", urlencode(pairs if done else [*pairs, (k, v)]), parts.fragment))
        except ValueError:
            return u

    return pd.Series([one(u, k, v) if u and k and v else u for u, k, v in zip(url, key, value, strict=True)])


def affiliate_url(url: Column, a: Column, account: Column | None = None) -> Column:
    """The address with the store's affiliate settings: struct(kind, key, value, template, merchant, affiliate, ref).

    kind parameter sets a query parameter, path fills {url} and {code} of a template, network builds the
    redirect of a network with one account, suffix appends; whatever is incomplete leaves the address.
    """
    mine = F.coalesce(a["affiliate"], account if account is not None else F.lit(None).cast("string"))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    ref = F.when(some(a["ref"]), F.concat(F.lit("&clickref="), encode_component(a["ref"]))).otherwise("")
    network = F.concat(F.lit("https://www.awin1.com/cread.php?awinmid="), encode_component(a["merchant"]), F.lit("&awinaffid="), encode_component(mine), ref, F.lit("&ued="), encode_component(url))
    path = F.replace(F.replace(a["template"], F.lit("{url}"), encode_component(url)), F.lit("{code}"), encode_component(F.coalesce(a["value"], F.lit(""))))
    suffix = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.regexp_replace(a["value"], "^[?&]", ""))
    return (
        F.when((a["kind"] == "parameter") & some(a["key"]) & some(a["value"]), _set_parameter(url, a["key"], a["value"]))
        .when((a["kind"] == "path") & some(a["template"]), path)
        .when((a["kind"] == "network") & some(a["merchant"]) & some(mine), network)
        .when((a["kind"] == "suffix") & some(a["value"]), suffix)
        .otherwise(url)
    )


def affiliate_usable(a: Column, account: Column | None = None) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    mine = F.coalesce(a["affiliate"], account if account is not None else F.lit(None).cast("string"))
    return F.coalesce(F.when(a["kind"] == "path", some(a["template"])).when(a["kind"] == "network", some(a["merchant"]) & some(mine)).when(a["kind"].isNotNull(), some(a["value"])), F.lit(False))


def pacing(requests: DataFrame, gap_ms: int = 700) -> DataFrame:
    """start_ms of each request (host, ordinal): one at a time per host, ``gap_ms`` apart."""
    return requests.withColumn("start_ms", (F.row_number().over(Window.partitionBy("host").orderBy("ordinal")) - 1) * gap_ms)


def next_wait(wait: int, until: int, status: int, retry: float, at: int | None, first_ms: int = 6000, most_ms: int = 90_000, gap_ms: int = 700, longest_s: int = 120, least_age_ms: int = 60_000) -> tuple[int, int]:
    """(gap, when it is forgotten) after a response with ``status`` at ``at`` (null: gaps are never forgotten)."""
    if at is not None and wait and at >= until:
        wait = 0
    if status in (429, 503):
        wait = int(min(retry, longest_s) * 1000) if retry == retry and retry else min(most_ms, wait * 2 or first_ms)
        return wait, (at or 0) + max(4 * wait, least_age_ms)
    return (wait // 2 if wait // 2 > gap_ms else 0), until


def backoff(responses: DataFrame, **limits: int) -> DataFrame:
    """(host, ordinal, wait_ms): what each response leaves as the host's gap.

    A 429 or 503 takes its Retry-After (120 s at most) or doubles from ``first_ms``; a success halves,
    down to none.  With a column at_ms a gap is forgotten once the refusal that set it is older than
    four times that gap, and than a minute.  A fold over a host's responses, in order; ``limits`` as in ``next_wait``.
    """
    timed = "at_ms" in responses.columns
    rows = responses.select("host", "ordinal", "status", F.col("retry_after").cast("double").alias("retry_after"), (F.col("at_ms") if timed else F.lit(0)).cast("long").alias("at_ms"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        wait, until, out = 0, 0, []
        for status, retry, at in frame[["status", "retry_after", "at_ms"]].itertuples(index=False):
            wait, until = next_wait(wait, until, status, retry, at if timed else None, **limits)
            out.append(wait)
        return pd.DataFrame({"host": frame["host"].iloc[0], "ordinal": frame["ordinal"].to_numpy(), "wait_ms": out})

    return rows.groupBy("host").applyInPandas(run, "host string, ordinal long, wait_ms long")
