"""Op 3: personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (e-mail, IP address, card, phone) come from patterns; their places are found without
user code: the text split at a pattern gives the gaps, whose lengths and the matches' lengths add up
to offsets in code points.  Patterns are written so that each scans a text once (no match can begin
inside a run that failed), whatever its length.

The bootstrap: identifiers and their lexical patterns form a graph.  An identifier is a word with a
digit or @ (and the digit groups after it), or what a name and = or : assign; its patterns are the
word before it, the two words before it, the word after it, or the name that it is assigned to.
Seeds are the values found as base entities, and keys and tokens of well-known form (kind secret).
Each round scores a pattern by the share of its occurrences whose value is a seed of its kind;
patterns with a high score and enough different seeds make the other values behind them seeds of the
next round, which in turn can make further patterns, until a round finds nothing new.  Occurrences
in a trusted pattern are given, so a value that is accepted in one place is no find everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precioscope.functions.text import let
from precioscope.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Equivalent to the plain patterns; possessive, and begun only where a run begins.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){13}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Forms of keys and tokens that stand for themselves.
SECRET = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)[.,;:!?)\"']*$"
#: An assigned value that looks random: hexadecimal, with letters and digits.
RANDOM = r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}$"
IDENTIFIER = r"(?<!\S)(?=\S*?[0-9@])\S++(?:\x20[0-9().-]++(?!\S))*+"
#: A name, = or :, perhaps in quotes, and what is assigned.
ASSIGNMENT = r"(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]*+[\"']?\x20?[=:]\x20?[\"']?[^\s\"',;=]++"
ASSIGNED = r"^([A-Za-z_][A-Za-z0-9_.-]*+[\"']?\x20?[=:]\x20?[\"']?)(.*)$"
LAST_WORD, LAST_WORDS, NEXT_WORD = r"(?:^|\s)(\S+)\s$", r"(?:^|\s)(\S+\s\S+)\s$", r"^\s(\S+)(?:\s|$)"
#: Longer words than this are no lexical pattern, shorter values no find.
WORD_CHARS, VALUE_CHARS = 40, 6
LEAST_SCORE = 0.8
LEAST_SEEDS = 5
MATCHES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Matches of a text are placed one after another up to this number, and in runs of about the root of it beyond.
FEW_MATCHES = 64


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return (n >= 10) & (n <= 15)


def _places(text: Column, pattern: str, with_context: bool = False) -> Column:
    """The leftmost non-overlapping matches as MATCHES; before and after hold up to 90 characters around each."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    near = lambda f, g: f(g, F.lit(90)) if with_context else F.lit("")
    trio = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.greatest(F.lit(0), F.size(found))).alias("h"))
    pairs = F.transform(trio, lambda p: F.struct(p["m"].alias("m"), F.length(p["g"]).alias("gap"), near(F.right, p["g"]).alias("before"), near(F.left, p["h"]).alias("after")))
    none = F.array().cast(MATCHES)

    def placed(pairs: Column, base: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["gap"]
            end = start + F.length(p["m"])
            one = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), p["m"].alias("value"), p["before"].alias("before"), p["after"].alias("after"))
            return F.struct(end.cast("int").alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(pairs, F.struct(base.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_runs(pairs: Column) -> Column:
        # Appending copies an array, so runs of the root of n keep the work of n matches near n ** 1.5.
        return let(F.ceil(F.sqrt(F.size(pairs))).cast("int"), lambda size: runs_of(F.transform(F.sequence(F.lit(0), ((F.size(pairs) - 1) / size).cast("int")), lambda k: F.slice(pairs, k * size + 1, size))))

    def runs_of(runs: Column) -> Column:
        def step(acc: Column, run: Column) -> Column:
            long = F.aggregate(run, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["m"]))
            return F.struct((acc["at"] + long).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        bases = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, bases, placed))

    return let(pairs, lambda p: F.when(F.size(p) <= FEW_MATCHES, placed(p, F.lit(0))).otherwise(in_runs(p)))


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind, its valid matches as MATCHES."""
    out = {}
    valid = lambda kind: lambda s: _valid(kind, s["value"])
    none = F.array().cast(MATCHES)
    for kind in KINDS:
        may = text.rlike(PATTERNS[kind])
        if kind in HINTS:
            may = F.contains(text, F.lit(HINTS[kind])) & may
        found = F.filter(_places(text, PATTERNS[kind]), valid(kind))
        out[kind] = F.when(may, found).otherwise(none)
    return out


def identifiers(text: Column) -> Column:
    """array<struct<start, end, value, patterns>> of words with a digit or @ and of assigned values."""
    word = lambda kind, x, pattern: F.when(F.length(F.regexp_extract(x, pattern, 1)).between(1, 2 * WORD_CHARS), F.concat(F.lit(kind), F.lower(F.regexp_extract(x, pattern, 1))))

    def free(s: Column) -> Column:
        patterns = F.array_compact(F.array(word("1 ", s["before"], LAST_WORD), word("2 ", s["before"], LAST_WORDS), word("> ", s["after"], NEXT_WORD)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), patterns.alias("patterns"))

    def assigned(s: Column) -> Column:
        name = F.regexp_extract(s["value"], ASSIGNED, 1)
        plain = F.regexp_replace(F.lower(name), r"[\"'\x20]", "")
        pattern = F.when(F.length(plain) <= WORD_CHARS, F.concat(F.lit("= "), plain))
        return F.struct((s["start"] + F.length(name)).cast("int").alias("start"), s["end"].alias("end"), F.regexp_extract(s["value"], ASSIGNED, 2).alias("value"), F.array_compact(F.array(pattern)).alias("patterns"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,patterns:array<string>>>")
    words = F.when(text.rlike("[0-9@]"), F.transform(_places(text, IDENTIFIER, True), free)).otherwise(none)
    values = F.when(text.rlike("[=:]"), F.transform(_places(text, ASSIGNMENT), assigned)).otherwise(none)
    return F.concat(words, values)


def _bootstrap(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, tie, kind, start, end) of identifiers in trusted patterns, and of secrets of known form."""
    ids = found.select("doc_id", "tie", F.explode("identifiers").alias("i"))
    # An identifier is of the kind of the first base match in its value, if any.
    in_value = base_spans(F.col("i.value"))
    known, random = F.col("i.value").rlike(SECRET), F.exists("i.patterns", lambda p: p.startswith("= ")) & F.col("i.value").rlike(RANDOM)
    kind = F.coalesce(*[F.when(F.size(in_value[k]) > 0, F.lit(k)) for k in KINDS], F.when(known | random, F.lit("secret")))
    occ = ids.select("doc_id", "tie", F.col("i.start").alias("start"), F.col("i.end").alias("end"), F.col("i.value").alias("value"), F.col("i.patterns").alias("patterns"), kind.alias("kind"), known.alias("known"))
    occ = scratch.cut(occ, "occurrences")
    rows = occ.select(F.explode("patterns").alias("pattern"), "value", "kind")
    graph = scratch.cut(rows.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "graph")
    trusted, n_trusted = None, 0
    while True:
        # How much of a pattern is of each kind; values of no kind count against all kinds.
        per = graph.groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seeds"))
        whole = per.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "seeds", "kind"))).alias("best"))
        fresh = whole.filter((F.col("best.seeds") >= LEAST_SEEDS) & (F.col("best.n") >= LEAST_SCORE * F.col("all")))
        old, trusted = trusted, scratch.cut(fresh.select("pattern", F.col("best.kind").alias("of")), "trusted")
        now = trusted.count()
        scratch.drop(old)
        if now <= n_trusted:
            break
        n_trusted = now
        # Values of no kind in a trusted pattern are seeds from now on, wherever they stand.
        unseen = graph.filter("kind is null").filter(F.length("value") >= VALUE_CHARS)
        accepted = scratch.cut(unseen.join(trusted, "pattern").groupBy("value").agg(F.min("of").alias("of")), "accepted")
        old, graph = graph, scratch.cut(graph.join(accepted, "value", "left").select("pattern", "value", "n", F.coalesce("kind", "of").alias("kind")), "graph")
        scratch.drop(old, accepted)
    open_ = occ.filter(F.col("kind").isNull() & (F.length("value") >= VALUE_CHARS))
    found = open_.select("doc_id", "tie", "start", "end", F.explode("patterns").alias("pattern")).join(trusted, "pattern")
    found = found.groupBy("doc_id", "tie", "start", "end").agg(F.min("of").alias("kind"))
    seeds = occ.filter("kind = 'secret'").select("doc_id", "tie", "start", "end", "kind")
    return found.unionByName(seeds).distinct()


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_spans of every row.

    ``docs`` has doc_id and text; other columns are ignored.  ``spans`` holds the base spans and those
    of the bootstrap, whose kinds are the same and ``secret``, which sorts last; n_spans is their
    number.  Null and empty texts have no spans (the hash is that of the empty string).  Rows that
    repeat a (doc_id, text) get the same spans each; a null doc_id is a document like others.  An
    empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = rows.select("doc_id", F.xxhash64("text").alias("tie"), *[slim(c).alias(k) for k, c in base_spans(F.col("text")).items()], identifiers(F.col("text")).alias("identifiers"))
    found = scratch.cut(found, "found")
    single = found.filter(F.size("identifiers") > 0).dropDuplicates(["doc_id", "tie"])
    extra = _bootstrap(single, scratch).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end", "kind")).alias("extra"))
    extra = scratch.cut(extra, "extra").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "extra")
    out = found.drop("identifiers").join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    every = (*KINDS, "secret")

    def tagged(kind: str, c: Column) -> Column:
        return F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(every.index(kind)).alias("order"), s["end"].alias("end")))

    def joined(spans: Column) -> Column:
        names = F.array(*map(F.lit, every))
        one = lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(F.array_sort(spans), one), ",")

    base = F.concat(*[tagged(k, F.col(k)) for k in KINDS])
    order = lambda s: (F.array_position(F.array(*map(F.lit, every)), s["kind"]) - 1).cast("int")
    more = F.transform(F.coalesce("extra", F.array().cast("array<struct<start:int,end:int,kind:string>>")), lambda s: F.struct(s["start"].alias("start"), order(s).alias("order"), s["end"].alias("end")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, more)).alias("spans"), (F.size(base) + F.size(more)).cast("long").alias("n_spans"))
