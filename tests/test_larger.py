"""What larger tables hold and the small ones do not."""

import json

from precioscope.functions import extract as E
from precioscope.functions.dom import parse


def _state(n, kind='<script id="__NEXT_DATA__" type="application/json">{}</script>'):
    return "<html><body>" + kind.replace("{}", json.dumps({"list": [{"productName": f"Produto azul n{i}", "price": "9.50", "link": f"/p/{i}"} for i in range(n)]})) + "</body></html>"


def test_embedded_state_is_read_to_its_end():
    for html in (_state(1000), _state(70_000, "<script>window.__STATE__ = {};</script>")):
        names = [x["name"] for x in E.from_state(parse(html), "https://a.b")]
        assert names == [f"Produto azul n{i}" for i in range(html.count("productName"))]


def test_listings_in_sql_are_whole(spark):
    from precioscope.functions.tables import register_tables

    register_tables(spark)
    pages = spark.createDataFrame([(1, "https://a.b/p", _state(1000))], "page_id long, url string, html string")
    assert spark.sql("SELECT count(DISTINCT l.name) AS n FROM {pages} p, LATERAL watch_listings(p.html, p.url) l", pages=pages).first()["n"] == 1000


def test_an_address_read_twice_is_one_offer(spark):
    from precioscope.operators.lifecycle import manual_offers

    links = spark.createDataFrame([(1, "https://a.b/x"), (2, "https://a.b/x"), (3, "https://a.b/x"), (4, "https://a.b/y")], "product_id long, url string")
    stores = spark.createDataFrame([(7, "https://www.a.b")], "store_id long, origin string")
    pages = spark.createDataFrame([(1, "https://a.b/x", 9.0, True), (2, "https://a.b/x", 0.0, True), (None, "https://a.b/x", 8.0, False), (9, "https://a.b/x", None, None)], "product_id long, url string, price double, available boolean")
    told = lambda p: sorted((r["product_id"], r["result"], r["price"], r["available"]) for r in manual_offers(links, stores, p).collect())
    assert told(pages) == [(1, "ok", 9.0, True), (2, "no_price", None, None), (3, "ok", 8.0, False), (4, "no_price", None, None)]
    assert told(pages.drop("product_id")) == [(1, "ok", 8.0, False), (2, "ok", 8.0, False), (3, "ok", 8.0, False), (4, "no_price", None, None)]


def test_a_price_of_zero_is_told_where_asked(spark, tmp_path):
    from pyspark.sql import functions as F

    from precioscope.streaming.notices import drained, live_notices

    rows = [(1, "s", 1, 10.0, True), (1, "t", 2, 9.9, True), (1, "s", 3, 0.0, True), (1, "s", 4, 5.0, True), (1, "t", 5, 4.0, True)]
    df = spark.createDataFrame(rows, "product_id long, store_id string, seq long, price double, available boolean").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def told(zero):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        return {(r["kind"], r["seq"], r["price"], r["reference_price"]) for r in drained(live_notices(stream, zero=zero), "zero").collect()}

    # As SQL over last_value(price) and min(price) has it.
    assert told(True) == {("all_time_low", 2, 9.9, 10.0), ("price_drop", 3, 0.0, 10.0), ("all_time_low", 3, 0.0, 9.9), ("best_between_stores", 3, 0.0, 9.9), ("best_between_stores", 4, 5.0, 9.9), ("price_drop", 5, 4.0, 9.9), ("best_between_stores", 5, 4.0, 5.0)}
    assert told(False) == {("all_time_low", 2, 9.9, 10.0), ("price_drop", 4, 5.0, 10.0), ("all_time_low", 4, 5.0, 9.9), ("best_between_stores", 4, 5.0, 9.9), ("price_drop", 5, 4.0, 9.9), ("all_time_low", 5, 4.0, 5.0), ("best_between_stores", 5, 4.0, 5.0)}


def test_shelf_finds_what_a_scan_finds():
    import random

    from precioscope.functions.identity import Shelf, identify, same_product

    r = random.Random(3)
    words = "azul preto grande com tampa de vidro mesa luz led suporte kit fogo aco inox".split()
    codes = ["xk1001", "xk1002", "rtx 5070", "zz900b", "16gb", "32gb", "ryzen 5 5600", "", ""]
    made = [identify(" ".join([r.choice(["Dell", "Samsung", ""]), *r.sample(words, r.randint(0, 6)), *r.sample(codes, r.randint(0, 2))]), r.choice([None, 10.0, 14.0, 30.0]), None, r.choice([None, None, "78900001", "78900002"])) for _ in range(500)]
    shelf, hits = Shelf(), 0
    for me in made:
        want = [i for i, x in enumerate(shelf.items) if same_product(me, x)[0] and me.key != x.key]
        assert set(want) <= set(shelf.candidates(me))
        hits += len(want)
        shelf.add(me)
    assert hits > 500


def test_equal_facts_follow_their_best_and_products_stay_many(spark):
    """Thousands of products a query: a listing meets few of them, not all."""
    from precioscope.functions import identity
    from precioscope.operators.resolve import assign_products

    n = 3000
    rows = [("q", 4 * i + j, f"Geladeira Samsung RF{1000 + i} 300L {('frost', 'inverse frost', 'frost com garantia', 'FROST')[j]}", 9.0, 50 + i % 7, i, False) for i in range(n) for j in range(4)] + [("q", 5 * n + i, f"Geladeira Samsung RF{1000 + i} 300L frost", 9.0, 1, i, False) for i in range(n)]
    got = assign_products(spark.createDataFrame(rows, "query_id string, listing_id long, name string, price double, score int, ordinal int, specific boolean"), 1 << 30).toPandas()
    assert len(got) == len(rows) and got["product_id"].nunique() == 2 * n and got["is_new"].sum() == 2 * n
    assert set(got[got["listing_id"] >= 5 * n]["rule"]) == {"key"}
    shelf = identity.Shelf()
    for x in rows[: 4 * n]:
        shelf.add(identity.identify(x[2]))
    assert len(shelf.candidates(identity.identify(rows[40][2]))) < 20


def test_models_meet_by_title_or_code_alone(spark):
    from precioscope.operators import entities as E

    sets = spark.createDataFrame([(i, ["geladeira", "samsung", "300l", "frost", f"rf{i}"], True) for i in range(300)] + [(1000, ["geladeira", "samsung", "300l", "frost"], False)], "node long, words array<string>, by_model boolean")
    assert {(r["a"], r["b"]) for r in E.similar_pairs(sets, 0.7, apart="by_model").collect()} == {(i, 1000) for i in range(300)}
    assert E.similar_pairs(sets.select("node", "words"), 0.88).filter("b < 1000").count() == 0


def test_followers_at_the_cap(spark):
    """As a loop over all listings: one that found no place may be followed by an equal one that finds its key."""
    from precioscope.operators.resolve import assign_products

    rows = [("q", 1, "Mesa grande azul de vidro", 10.0, 9, 1, False), ("q", 2, "Mesa azul grande de vidro temperado", 50.0, 8, 2, False), ("q", 3, "Mesa azul grande de vidro temperado", 10.0, 7, 3, False), ("q", 4, "Mesa azul grande de vidro temperado", 50.0, 6, 4, False), ("q", 5, "Cama", None, 5, 5, False)]
    got = assign_products(spark.createDataFrame(rows, "query_id string, listing_id long, name string, price double, score int, ordinal int, specific boolean"), 1)
    assert sorted((r["listing_id"], r["product_id"], r["rule"], r["is_new"]) for r in got.collect()) == [(1, "q-0", "new", True), (3, "q-0", "text", False), (4, "q-0", "key", False)]


def test_texts_are_scored_once(spark):
    from pyspark.sql import functions as F

    from precioscope.operators.interpret import interpret
    from precioscope.operators.score import score, score_texts

    asked = interpret(spark.createDataFrame([("1", "notebook dell zorkian"), ("2", "cadeira azul")], "query_id string, text string")).withColumnRenamed("accepted", "query_accepted").drop("reason", "text")
    names = ["Notebook Dell Zorkian ZK1000", "Cadeira azul de mesa", "Capa para notebook dell", None]
    seen = spark.range(400).select((F.col("id") % 2 + 1).cast("string").alias("query_id"), F.get(F.array(*map(F.lit, names)), (F.col("id") % 4).cast("int")).alias("name"), F.lit(None).cast("string").alias("gtin"), "id")
    columns = ["query_id", "id", "name", "gtin", "score", "accepted", "reason"]
    once = score_texts(seen, asked)
    assert sorted(map(str, once.select(columns).collect())) == sorted(map(str, score(seen.join(asked, "query_id")).select(columns).collect()))
    assert len(once.columns) == len(set(once.columns)) and "levenshtein" not in once._jdf.queryExecution().optimizedPlan().toString()  # no rule is left to each row


def test_long_numbers_are_one_model_with_their_word():
    from precioscope.functions.identity import identify, same_product

    for number in (99_999, 100_000, 1_234_567):
        a, b, c = identify(f"Geladeira Samsung RF{number}"), identify(f"geladeira samsung rf {number}"), identify(f"geladeira samsung rf {number + 1}")
        assert a.key == b.key == f"mod:samsung:rf{number}:::" and same_product(a, b)[0] and not same_product(a, c)[0]


def test_a_reference_that_was_cut_off_stays():
    got = E.page_outline('<title>a &amp;&amp; b &lt;c&gt; &amp</title><h1 title="x&y">d&am<b> &quot;e&quot;</b> f & g</h1>')
    assert got == {"title": "a && b <c> &amp", "heading": 'd&am "e" f & g'}


def test_summary_of_a_long_history_equals_sql(spark, tmp_path):
    import duckdb

    from precioscope.queries import ORACLES, QUERIES

    old = "SELECT 10 * g + i AS event_id, TIMESTAMP '2023-06-01' + INTERVAL (i * 30) DAY AS ts, g AS user_id, 'view' AS event_type, 10.0 + (i * 7 + g) % 9 AS value, '{\"k\": 1}' AS props FROM range(10) t(i), range(5) u(g)"
    duckdb.sql(f"COPY ({old}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = duckdb.sql(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet') SELECT product_id, rating, share_dearer FROM ({ORACLES['product_summary']})").fetchall()
    got = QUERIES["product_summary"](spark, str(tmp_path)).select("product_id", "rating", "share_dearer").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_of_one_scope_are_dealt_to_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from precioscope.operators import scope

    asked = spark.range(2000).coalesce(1).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit("europe"))).otherwise(F.array(F.lit("africa"), F.lit("us"))).alias("tokens"))
    stores = spark.createDataFrame([(1, ["europe"]), (2, ["afri"]), (3, []), (3, []), (4, ["asia"])], "store_id long, scope_words array<string>")
    want = sorted((q, s) for q in range(2000) for s in ([1] if q % 2 == 0 else [2]) + [3, 3])
    for few in (100, 1):
        monkeypatch.setattr(scope, "FEW", few)
        out = scope.store_serves(asked, stores)
        assert sorted((r["query_id"], r["store_id"]) for r in out.collect()) == want and set(out.columns) == {"query_id", "tokens", "store_id", "scope_words"}
        assert len([n for n in out.groupBy(F.spark_partition_id()).count().collect() if n["count"] > 0]) > 8


def test_a_list_of_many_products_is_read_in_linear_time():
    import time

    def took(n):
        html = '<script type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Product", "name": f"Produto azul n{i}", "offers": {"price": "9.50"}}} for i in range(n)]}) + "</script>"
        began = time.process_time()
        assert [x["name"] for x in E.from_jsonld(parse(html), None)] == [f"Produto azul n{i}" for i in range(n)]
        return time.process_time() - began

    took(100)
    assert took(40_000) < 16 * max(took(5_000), 0.05)


def test_listings_leave_a_page_in_parts(spark):
    """What is handed on at once is bounded, and blocks keep nothing of what was asked of them."""
    card = '<li class="card shelf"><a href="/p/{i}"><h3>Produto blue anvil n{i}</h3></a><del class="old">R$ 9.999,00</del><span class="price">R$ 9{i},10</span></li>'
    html = "<html><body><ul>" + "".join(card.replace("{i}", str(i)) for i in range(100, 400)) + "</ul></body></html>"
    root = parse(html)
    found = list(E.from_blocks(root, "https://a.b"))
    assert [(x["name"], x["price"], x["list_price"], x["url"]) for x in found] == [(f"Produto blue anvil n{i}", float(f"9{i}.1"), 9999.0, f"https://a.b/p/{i}") for i in range(100, 400)]
    assert all(n._below is None and n._text is None for li in root.walk() if li.tag == "li" for n in [li, *li.elements()])
    pages = spark.createDataFrame([(1, "https://a.b", html)], "page_id long, url string, html string")
    assert E.extract_listings(pages).count() == 300 and "ROWS" in vars(E)
    from precioscope.functions import tables

    tables.register_tables(spark)
    assert spark.sql("SELECT max(l.price) AS m, count(*) AS n FROM {p} p, LATERAL watch_listings(p.html, p.url) l", p=pages).first()[:] == (9399.1, 300)
    assert "ArrowEvalPythonUDTF" in spark.sql("SELECT l.* FROM {p} p, LATERAL watch_listings(p.html, p.url) l", p=pages)._jdf.queryExecution().toString()
