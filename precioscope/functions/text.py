"""Normalisation, tokens, quantities and similarity as column expressions.

``normalise`` gives plain ASCII, so every later pattern means the same in any engine.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from precioscope import lexicon as L


def _folding() -> tuple[str, str]:
    """Letters of Latin-1 to Latin Extended-B with marks, and their bases, from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(0x300 <= ord(x) < 0x370 for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


FOLD_FROM, FOLD_TO = _folding()


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once and named, so that expressions do not grow with its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literals(values: list[str]) -> Column:
    """An array literal, parsed as one expression."""
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"array({', '.join(quoted)})")


def fold_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, FOLD_FROM, FOLD_TO), "[̀-ͯ]", "")


def normalise(x: Column) -> Column:
    """Lower case, no accents, curly quotes straight, only word characters and . , + " ' -, single spaces."""
    s = F.translate(fold_accents(F.lower(F.coalesce(x, F.lit("")))), "”“„", '"""')
    s = F.regexp_replace(s, r"[^A-Za-z0-9_\s.,+\"'-]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def compact(x: Column) -> Column:
    return compact_normal(normalise(x))


def compact_normal(n: Column) -> Column:
    """The compact form of text that is normalised already."""
    return F.regexp_replace(n, r"[\s.-]+", "")


def tokens_normal(n: Column) -> Column:
    stop = literals(L.STOP_WORDS)
    return F.filter(F.split(n, r"[\s,]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def tokens(x: Column) -> Column:
    """Words of 2 letters or more that are no stop words, repeats kept."""
    return tokens_normal(normalise(x))


def normal_voltage(spec: Column) -> Column:
    """100-130 v is one mains voltage, 200-250 v the other."""
    v = F.regexp_extract(spec, r"^(\d{2,3})v$", 1).try_cast("int")
    return F.when(v.between(100, 130), "127v").when(v.between(200, 250), "220v").otherwise(spec)


def specs_normal(n: Column) -> Column:
    """Distinct quantities ("12gb", "15.6pol", "127v") and dry attributes, in order of appearance."""
    found = F.zip_with(F.regexp_extract_all(n, F.lit(L.QUANTITY), F.lit(1)), F.regexp_extract_all(n, F.lit(L.QUANTITY), F.lit(2)), lambda a, u: F.concat(F.replace(a, F.lit(","), F.lit(".")), F.when(u.isin("polegadas", '"'), "pol").otherwise(u)))
    dry = F.transform(F.regexp_extract_all(n, F.lit(L.DRY_ATTRIBUTE), F.lit(1)), lambda s: F.regexp_replace(s, r"\s+", ""))
    return F.array_distinct(F.transform(F.concat(found, dry), normal_voltage))


def processors_normal(n: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(n, F.lit(L.PROCESSOR), F.lit(1)), lambda s: F.regexp_replace(s, r"\s+", "")))


def find_brand(n: Column, c: Column) -> Column:
    """The brand that stands first as words; else one of 5 letters or more inside the compact text."""
    return let(F.struct(F.concat(F.lit(" "), n, F.lit(" ")).alias("p"), c.alias("c")), lambda v: _brand_in(v["p"], v["c"]))


def _brand_in(padded: Column, c: Column) -> Column:
    def place(brand: Column) -> Column:
        small = F.regexp_replace(brand, "[ .-]", "")
        words, inside = F.instr(padded, F.concat(F.lit(" "), brand, F.lit(" "))), F.instr(c, small)
        where = F.when(words > 0, words - 1).when((F.length(brand) >= 5) & (inside > 0), inside + 999)
        return F.struct(where.alias("at"), (-F.length(brand)).alias("size"), brand.alias("brand"))

    found = F.filter(F.transform(literals(L.BRANDS), place), lambda b: b["at"].isNotNull())
    return F.array_min(found)["brand"]


def find_category(n: Column) -> Column:
    """The longest category that stands as words, singular or with an s; the earlier of equals."""
    return let(F.concat(F.lit(" "), n, F.lit(" ")), _category_in)


def _category_in(padded: Column) -> Column:
    plain = [unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode() for name in L.CATEGORIES]
    names = literals(L.CATEGORIES)
    hit = lambda c: F.contains(padded, F.concat(F.lit(" "), c, F.lit(" "))) | F.contains(padded, F.concat(F.lit(" "), c, F.lit("s ")))
    rows = F.transform(literals(plain), lambda c, i: F.when(hit(c), F.struct((-F.length(c)).alias("size"), i.alias("place"))))
    return F.get(names, F.array_min(F.array_compact(rows))["place"])


def find_line(words: Column) -> Column:
    """(line, brand) of the first known product line among the tokens."""
    known, brands = literals(list(L.LINES)), literals([v or "" for v in L.LINES.values()])
    rows = F.filter(F.arrays_zip(known.alias("line"), brands.alias("brand")), lambda r: F.array_contains(words, r["line"]))
    return F.get(F.transform(rows, lambda r: F.struct(r["line"].alias("line"), F.nullif(r["brand"], F.lit("")).alias("brand"))), F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """0.45 * Jaccard + 0.55 * share of the smaller token set; 0 if either is empty."""
    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), lambda v: _similar(v["a"], v["b"]))


def _similar(a: Column, b: Column) -> Column:
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((n == 0) | (m == 0), F.lit(0.0)).otherwise(0.45 * (both / (n + m - both)) + 0.55 * (both / F.least(n, m)))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def mentions(words: Column, compacted: Column, wanted: Column) -> Column:
    """Is the word there, as a token, inside the compact text, or (5 letters or more) one edit away?"""
    near = F.exists(words, lambda t: (F.abs(F.length(t) - F.length(wanted)) <= 1) & within_one_edit(t, wanted))
    return F.array_contains(words, wanted) | F.contains(compacted, wanted) | ((F.length(wanted) >= 5) & near)


def units_conflict(a: Column, b: Column) -> Column:
    """Do two spec lists name the same unit with values of which neither list holds the other's?"""
    unit = lambda s: F.regexp_extract(s, r"([a-z\"]+)$", 1)
    units = F.filter(F.array_intersect(F.transform(a, unit), F.transform(b, unit)), lambda u: u != "")

    def fight(u: Column) -> Column:
        x, y = F.filter(a, lambda s: unit(s) == u), F.filter(b, lambda s: unit(s) == u)
        return (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0)

    return F.exists(units, fight)


def trusted_brand(title: Column, brand: Column, store: Column | None = None, host: Column | None = None) -> Column:
    """The title's known brand, else the store's field unless it looks like a company, is empty in words,
    is longer than 28 characters or is the store itself."""
    own = let(normalise(title), lambda n: find_brand(n, compact_normal(n)))
    field = F.trim(F.coalesce(brand, F.lit("")))
    bare = lambda x: F.regexp_replace(fold_accents(F.lower(F.coalesce(x, F.lit("")))), "[^a-z0-9]", "")
    bad = field.rlike(L.COMPANY) | field.rlike(L.NO_BRAND) | (F.length(field) > 28)
    for same in ([bare(store)] if store is not None else []) + ([bare(F.split(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), "^https?://", ""), r"^www\.", ""), r"\.")[0])] if host is not None else []):
        bad = bad | ((bare(field) != "") & (bare(field) == same))
    return F.coalesce(own, F.when(bad, F.lit("")).otherwise(field))
