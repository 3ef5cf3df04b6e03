"""Attributes of a listing title and guided-search facets."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precioscope import lexicon as L
from precioscope.functions.text import let, normalise

FIELDS = ("processor", "generation", "memory", "storage", "screen", "voltage", "colour", "model", "capacity")
#: Names of the fields as shown, and written sizes.
LABELS = dict(zip(FIELDS, ("Processador", "Variação", "Memória", "Armazenamento", "Tela", "Voltagem", "Cor", "Modelo", "Capacidade"), strict=True))
SIZE = r"(\d+(?:[.,]\d+)?)\s*(gb|tb|mb)\b"
NEARBY = 18


def _find(n: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(n, pattern, group), F.lit(""))


def _dot(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("."))


def _processor(n: Column) -> tuple[Column, Column]:
    families = (("m", r"\bm([1-5])\b(?:\s+(pro|max|ultra))?"), ("ryzen", r"\bryzen\s*([3579])\b(?:\s+(pro|max|ultra|ti))?"), ("corei", r"\bcore\s*i([3579])\b(?:\s+(pro|max|ultra|ti))?"))
    base = F.coalesce(*[F.concat(F.lit(name), _find(n, p)) for name, p in families])
    variant = reduce(lambda acc, np: acc.when(_find(n, np[1]).isNotNull(), F.concat(F.lit(np[0]), _find(n, np[1]), _find(n, np[1], 2))), families[1:], F.when(_find(n, families[0][1]).isNotNull(), F.concat(F.lit("m"), _find(n, families[0][1]), _find(n, families[0][1], 2))))
    return base, variant


def _sizes(n: Column) -> Column:
    """array<struct<value, amount, tb, ram, disk>>: what stands within 18 characters of each size, as far
    as the neighbouring sizes, says whether it is memory or storage."""
    parts = F.struct(F.split(n, SIZE, -1).alias("g"), *[F.regexp_extract_all(n, F.lit(SIZE), F.lit(i)).alias(c) for i, c in ((1, "n"), (2, "u"))])
    return let(parts, lambda p: _size_rows(p["g"], p["n"], p["u"]))


def _size_rows(gaps: Column, numbers: Column, units: Column) -> Column:
    def row(number: Column, i: Column) -> Column:
        unit = F.get(units, i)
        around = F.concat(F.right(F.get(gaps, i), F.lit(NEARBY)), F.lit(" "), F.substring(F.get(gaps, i + 1), 1, NEARBY))
        amount = _dot(number).cast("double") * F.when(unit == "tb", 1024).otherwise(1)
        return F.struct(F.concat(_dot(number), unit).alias("value"), amount.alias("amount"), (unit == "tb").alias("tb"), around.rlike(r"\b(?:ram|memoria)\b").alias("ram"), around.rlike(r"\b(?:ssd|armazenamento|hd|rom|disco)\b").alias("disk"))

    return F.transform(numbers, row)


def _memory_storage(n: Column) -> Column:
    """struct(memory, storage): labelled sizes first, then the rest by order of magnitude."""
    start = F.struct(F.lit(None).cast("string").alias("memory"), F.lit(None).cast("string").alias("storage"), F.array().cast("array<struct<amount:double,value:string>>").alias("rest"))

    def take(acc: Column, s: Column) -> Column:
        to_memory = ~s["tb"] & s["ram"] & acc["memory"].isNull()
        to_storage = ~to_memory & (s["tb"] | s["disk"]) & acc["storage"].isNull()
        loose = ~to_memory & ~to_storage & ~s["tb"]
        return F.struct(F.when(to_memory, s["value"]).otherwise(acc["memory"]).alias("memory"), F.when(to_storage, s["value"]).otherwise(acc["storage"]).alias("storage"), F.when(loose, F.array_append(acc["rest"], F.struct(s["amount"].alias("amount"), s["value"].alias("value")))).otherwise(acc["rest"]).alias("rest"))

    def finish(acc: Column) -> Column:
        low, high, k = F.array_min(acc["rest"]), F.array_max(F.transform(acc["rest"], lambda r: F.struct(r["amount"].alias("amount"), r["value"].alias("value")))), F.size(acc["rest"])
        none = acc["memory"].isNull() & acc["storage"].isNull()
        memory = F.when(acc["memory"].isNotNull(), acc["memory"]).when(k >= 2, low["value"]).when((k == 1) & (~none | (low["amount"] <= 64)), low["value"])
        alone = (k == 1) & F.when(none, low["amount"] > 64).otherwise(acc["memory"].isNotNull())
        storage = F.when(acc["storage"].isNotNull(), acc["storage"]).when(k >= 2, high["value"]).when(alone, low["value"])
        return F.struct(memory.alias("memory"), storage.alias("storage"))

    return F.aggregate(_sizes(n), start, take, finish)


def _colour(n: Column) -> Column:
    """The colour whose match begins right-most; the longer one of equals, the earlier pattern after that."""
    found = []
    for i, (pattern, name) in enumerate(L.COLOURS):
        bounded = rf"\b{pattern}\b"
        gaps, hits = F.split(n, bounded, -1), F.regexp_extract_all(n, F.lit(f"({bounded})"), F.lit(1))
        last = F.element_at(hits, -1)
        at = F.length(n) - F.length(F.element_at(gaps, -1)) - F.length(last)
        found.append(F.when(n.rlike(bounded), F.struct(at.alias("at"), F.length(last).alias("size"), F.lit(-i).alias("place"), F.lit(name).alias("name"))))
    return F.array_max(F.array_compact(F.array(*found)))["name"]


def attributes(title: Column) -> Column:
    """struct of the nine attributes; null where the title does not tell."""
    return let(normalise(title), _attributes)


def _attributes(n: Column) -> Column:
    processor, generation = _processor(n)
    both = _memory_storage(n)
    volts = _find(n, r"\b(\d{2,3})\s?v(?:olts?)?\b").cast("int")
    voltage = F.when(n.rlike(r"\bbivolt\b"), "bivolt").when(volts.between(100, 130), "127v").when(volts.between(200, 250), "220v")
    litres = r"(\d+(?:[.,]\d+)?)\s*(ml|litros?|l)\b"
    capacity = F.concat(_dot(_find(n, litres)), F.when(_find(n, litres, 2) == "ml", "ml").otherwise("l"))
    screen = F.concat(_dot(_find(n, r"(\d+(?:[.,]\d+)?)\s*(?:polegadas|pol\.?|\")")), F.lit("pol"))
    values = (processor, generation, let(both, lambda v: v["memory"]), let(both, lambda v: v["storage"]), screen, voltage, _colour(n), _find(n, r"\b(a\d{4})\b"), capacity)
    return F.struct(*[v.alias(f) for f, v in zip(FIELDS, values, strict=True)])


def label(field: Column, value: Column) -> Column:
    """What people read: M4 Pro, 512 GB, 13 polegadas, 127V, 1.5 L."""
    chip = F.regexp_extract(value, r"^(m|ryzen|corei)(\d)", 1)
    more = F.initcap(F.regexp_extract(value, r"^(?:m|ryzen|corei)\d(pro|max|ultra|ti)$", 1))
    name = F.concat(F.when(chip == "m", "M").when(chip == "ryzen", "Ryzen ").otherwise("Core i"), F.regexp_extract(value, r"(\d)", 1), F.when(more != "", F.concat(F.lit(" "), more)).otherwise(""))
    dashed = F.array_join(F.transform(F.split(value, "-"), F.initcap), "-")
    sized = F.regexp_replace(value, r"^(\d+(?:\.\d+)?)(gb|tb|mb)$", "$1 $2")
    return (
        F.when(field.isin("processor", "generation"), F.when(chip != "", name).otherwise(F.initcap(value)))
        .when(field.isin("memory", "storage"), F.upper(sized))
        .when(field == "screen", F.concat(F.replace(value, F.lit("pol"), F.lit("")), F.lit(" polegadas")))
        .when(field == "voltage", F.when(value == "bivolt", "Bivolt").otherwise(F.upper(value)))
        .when(field == "colour", dashed)
        .when(field == "model", F.upper(value))
        .when(field == "capacity", F.when(value.endswith("ml"), F.regexp_replace(value, "ml$", " ml")).otherwise(F.regexp_replace(value, "l$", " L")))
        .otherwise(value)
    )


def facet_counts(items: DataFrame, fields: list[str], least_share: float = 0.15, most_options: int = 8) -> DataFrame:
    """Options of each field worth filtering by: field, value, count, option_rank, facet_rank.

    A field needs two values and a share of ``least_share`` of the items; options are its most frequent
    (ties: seen first by ``ordinal``); fields rank by how evenly they split, then by coverage.  Counts
    are aggregated before any window, so windows see one row per value.
    """
    total = items.agg(F.count(F.lit(1)).alias("total"))
    tall = items.unpivot(["ordinal"], list(fields), "field", "value").filter("value is not null")
    counts = tall.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"), F.min("ordinal").alias("seen"))
    per = Window.partitionBy("field")
    counts = counts.withColumn("values", F.count(F.lit(1)).over(per)).withColumn("covered", F.sum("count").over(per))
    counts = counts.join(F.broadcast(total)).filter((F.col("values") >= 2) & (F.col("covered") >= least_share * F.col("total")))  # one row
    ranked = counts.withColumn("option_rank", F.row_number().over(per.orderBy(F.col("count").desc(), "seen"))).filter(F.col("option_rank") <= most_options)
    use = ranked.groupBy("field").agg((1 - F.max("count") / F.max("covered")).alias("evenness"), F.max("covered").alias("cover"))
    place = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f, i)])
    order = Window.orderBy(F.col("evenness").desc(), F.col("cover").desc(), F.element_at(place, F.col("field")))  # one row a field
    use = use.withColumn("facet_rank", F.row_number().over(order))
    return ranked.join(F.broadcast(use), "field").select("field", "value", "count", "option_rank", "facet_rank")


def apply_filters(items: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """Any of a field's values, all of the fields; empty choices do not filter, null never matches."""
    active = [F.col(f).isin(list(v)) for f, v in chosen.items() if isinstance(v, (list, tuple)) and v]
    return items.filter(reduce(and_, active)) if active else items


def describe_filters(chosen: dict[str, list]) -> Column:
    """M4 ou M4 Pro · 16 GB, in the fixed order of fields."""
    parts = [F.concat_ws(" ou ", *[label(F.lit(f), F.lit(v)) for v in chosen[f]]) for f in FIELDS if chosen.get(f)]
    return F.concat_ws(" · ", *parts) if parts else F.lit("")
