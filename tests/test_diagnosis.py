"""Search addresses, trials and sitemaps on small hand-made tables; medians and places without group arrays."""

from pyspark.sql import functions as F

from precioscope.operators import diagnosis as D
from precioscope.operators import sitemaps as Z
from precioscope.operators.history import absence_streaks
from precioscope.operators.summary import median_name, with_upper_median
from precioscope.operators.views import numbered

LIBRARY = "ordinal long, host string, search_url string"
STORE = "store_id long, origin string, html string, told string"


def patterns(spark, stores, library=()):
    out = D.search_patterns(spark.createDataFrame(stores, STORE), spark.createDataFrame(list(library), LIBRARY)).orderBy("store_id", "ordinal").collect()
    return [(r.pattern, r.source, r.worth_browser) for r in out]


def test_usual_paths_alone(spark):
    got = patterns(spark, [(1, "https://a.com/", None, None)])
    assert [p for p, _, _ in got] == ["https://a.com" + p for p in D.SEARCH_PATHS[:10]]
    assert [w for _, _, w in got] == [True] + [False] * 9


def test_order_of_sources_and_repeats(spark):
    html = '<form><input name="Q"><input type="hidden" name="a b" value="&#231;"></form><form action="?x=1"><input id="SearchBox" name="z"></form><form method="POST"><input name="q"></form>'
    library = [(2, "www.a.com", "https://late/{q}"), (1, "A.com", "https://a.com/busca?q={q}"), (0, "a.com", None)]
    got = patterns(spark, [(1, "https://www.a.com", html, "https://a.com/t/{t}")], library)
    assert got[:4] == [("https://a.com/t/{t}", "told", True), ("https://a.com/busca?q={t}", "library", True), ("https://www.a.com/?Q={t}&a%20b=%C3%A7", "form", True), ("https://www.a.com?x=1&z={t}", "form", True)]
    assert len(got) == 10


def test_form_edge_cases(spark):
    broken = '<form action="javascript:go()"><input name="q"></form><form><input type="search"></form><form><input name="email"></form><form><input name="q"'
    assert [s for _, s, _ in patterns(spark, [(1, "https://a.com", broken, None), (2, "https://b.com", "", None)])] == ["usual"] * 20
    assert D.search_patterns(spark.createDataFrame([], STORE), spark.createDataFrame([], LIBRARY)).count() == 0


def test_address_takes_first_mark_only(spark):
    row = spark.range(1).select(D.search_address(F.lit("/x?a={t}&b={t}"), F.lit("https://a.com/"), F.lit("são $1 (x)")).alias("a"), D.search_address(F.lit("https://b.com/none"), F.lit("https://a.com/"), F.lit("y")).alias("b")).first()
    assert row.a == "https://a.com/x?a=s%C3%A3o%20%241%20(x)&b={t}" and row.b == "https://b.com/none"


TRIED = "store_id long, ordinal int, pattern string, strategy string, items int, priced int, linked int, with_code int, relevance double, home boolean, answered boolean, blocked boolean, structured boolean"


def tried(spark, rows):
    return spark.createDataFrame([(s, o, f"p{o}", k, n, n, n, 1, rel, home, ok, bad, k == "jsonld") for s, o, k, n, rel, home, ok, bad in rows], TRIED)


def test_trying_ends_at_a_good_address(spark):
    rows = [(1, 1, "blocks", 5, 1.0, False, True, False), (1, 2, "jsonld", 8, 0.7, False, True, False), (1, 3, "jsonld", 99, 1.0, False, True, False)]
    rows += [(2, o, "blocks", 3, 0.5, False, o != 8, False) for o in range(1, 11)]
    made = D.trials(tried(spark, rows)).groupBy("store_id").agg(F.max("ordinal").alias("m")).collect()
    assert {r.store_id: r.m for r in made} == {1: 2, 2: 9}  # the eighth did not answer, so the ninth is tried too
    got = {r.store_id: r for r in D.diagnose_trials(tried(spark, rows)).collect()}
    assert (got[1].pattern, got[1].verdict, got[1].trials) == ("p2", "compatible", 2)
    assert (got[2].pattern, got[2].verdict) == ("p1", "partial")  # the first of equals


def test_verdicts_without_a_usable_address(spark):
    rows = [(1, 1, "blocks", 0, 1.0, False, False, True), (1, 2, "blocks", 9, 0.19, False, True, False), (2, 1, "jsonld", 9, 1.0, True, True, False), (3, 1, "jsonld", 9, None, None, True, None)]
    got = {r.store_id: (r.verdict, r.limits, r.pattern, r.points) for r in D.diagnose_trials(tried(spark, rows)).collect()}
    assert got == {1: ("incompatible", "search_blocked", None, 0.0), 2: ("incompatible", "search_not_found", None, 0.0), 3: ("incompatible", "search_not_found", None, 0.0)}


def test_sitemaps(spark):
    loc = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    stores = spark.createDataFrame([(i, f"https://{c}.com/") for i, c in enumerate("abcd")], "store_id long, origin string")
    index = "<sitemapindex>" + loc(*[f"https://b.com/m{i}" for i in range(7)])
    bodies = [("https://a.com/sitemap.xml", False, loc("x")), ("https://a.com/sitemap/sitemap.xml", True, loc("z", "y", "z")), ("https://b.com/sitemap.xml", True, index), *[(f"https://b.com/m{i}", i != 1, loc(f"u{i}")) for i in range(7)], ("https://c.com/sitemap.xml", True, "<sitemapindex>" + loc("gone")), ("https://c.com/sitemap_index.xml", True, None)]
    got = Z.read_sitemaps(stores, spark.createDataFrame(bodies, "url string, ok boolean, body string")).orderBy("store_id", "ordinal").collect()
    assert [(r.store_id, r.place, r.url) for r in got] == [(0, 2, "z"), (0, 2, "y"), (0, 2, "z"), *[(1, 0, f"u{i}") for i in (0, 2, 3, 4)]]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    read = spark.createDataFrame([(0, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01")], "store_id long, t string").select("store_id", F.col("t").cast("timestamp").alias("read_at"))
    assert sorted(r.store_id for r in Z.stale_sitemaps(stores, read, now).collect()) == [0, 2, 3]


def test_medians_equal_sorted_groups(spark):
    rows = [(k, p, f"{'n' * (p or 1)}{p}", i) for i, (k, p) in enumerate([("a", 3), ("a", 1), ("a", 3), ("a", 9), ("b", 5), ("b", None), ("c", None), (None, 2), (None, 4), (None, 2)])]
    df = spark.createDataFrame(rows, "k string, price int, name string, ordinal int")
    assert {r.k: r.median for r in with_upper_median(df, F.col("price"), "k").collect()} == {"a": 3, "b": 5, "c": None, None: 2}
    plain = {}
    for k, _, name, i in rows:
        plain.setdefault(k, []).append((len(name), i, name))
    expect = {k: sorted(v)[len(v) // 2][2] for k, v in plain.items()}
    assert {r.k: r.name for r in median_name(df, "k").collect()} == expect


def test_places_follow_the_order(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("v")).repartition(5)
    keys = [F.col("v").asc_nulls_last(), F.col("id").desc()]
    got = {r.id: r.position for r in numbered(df, keys).collect()}
    order = sorted(range(500), key=lambda i: (i % 7 == 0, i % 3 if i % 7 else 0, -i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    assert numbered(df.limit(0), keys).count() == 0


def test_absence_needs_no_pairing_of_rounds(spark):
    seen = spark.createDataFrame([("p", "s", 2), ("p", "s", 2), ("p", "s", 9), ("q", "s", 5)], "product_id string, store_id string, round_no int")
    out = absence_streaks(seen, spark.createDataFrame([(n,) for n in (1, 2, 5, 7, 9)], "round_no int"))
    assert sorted((r.product_id, r.round_no, r.absent) for r in out.collect()) == [("p", 2, 0), ("p", 5, 3), ("p", 7, 5), ("p", 9, 0), ("q", 5, 0), ("q", 7, 2), ("q", 9, 4)]
