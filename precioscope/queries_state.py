"""Queries of lifecycle, crawl decisions, charts and lists, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from precioscope.functions import money as C
from precioscope.functions import policy as P
from precioscope.operators import crawl as W
from precioscope.operators import history as H
from precioscope.operators import lifecycle as Y
from precioscope.operators import opportunity as O
from precioscope.operators import summary as M
from precioscope.operators import views as V
from precioscope.queries import AS_OF, BEST, CURRENT, DAILY, READINGS, RUNNING, query, readings, table

FILLED = f"""{DAILY}, a AS (SELECT max(ts) AS as_of FROM r), f AS (SELECT product_id, min(day) AS first_day, any_value(as_of) AS as_of FROM d, a GROUP BY product_id),
    s AS (SELECT *, CAST(first_day AS TIMESTAMP) + INTERVAL 12 HOUR > as_of - INTERVAL 14 DAY AS late FROM f),
    c AS (SELECT product_id, CAST(unnest(generate_series(CASE WHEN late THEN CAST(first_day AS TIMESTAMP) ELSE date_trunc('day', as_of - INTERVAL 14 DAY) END, CAST(CASE WHEN late AND hour(as_of) < 12 THEN CAST(as_of AS DATE) - 1 ELSE CAST(as_of AS DATE) END AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s),
    j AS (SELECT c.product_id, c.day, low, high, readings FROM c LEFT JOIN d USING (product_id, day)),
    x0 AS (SELECT product_id, day, last_value(low IGNORE NULLS) OVER w AS low, last_value(high IGNORE NULLS) OVER w AS high, readings IS NULL AS estimated FROM j WINDOW w AS (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    x AS (SELECT * FROM x0 WHERE low IS NOT NULL)"""


def _filled(spark, sf_dir):
    r = readings(spark, sf_dir)
    return H.filled_series(r, F.lit(r.agg(F.max("ts")).first()[0]), 15)


# --- charts


@query(
    "chart_domains",
    f"""WITH {FILLED}, t AS (SELECT c_custkey AS product_id, abs(c_acctbal) / 200 AS target FROM customer),
    p AS (SELECT *, estimated OR lag(estimated) OVER w AS guess, lag(day) OVER w IS NOT NULL AS joins FROM x WINDOW w AS (PARTITION BY product_id ORDER BY day)),
    g AS (SELECT product_id, count(*) AS days, min(low) AS band_low, max(high) AS band_high, arg_min(day, struct_pack(l := low, d := day)) AS lowest_day, count(*) FILTER (joins AND guess) AS dashed FROM p GROUP BY product_id HAVING count(*) >= 2),
    b AS (SELECT g.*, least(band_low, target) AS bottom, greatest(band_high, target) AS top FROM g LEFT JOIN t USING (product_id)),
    k AS (SELECT *, CASE WHEN top > bottom THEN (top - bottom) * 0.08::DOUBLE WHEN top > 0 THEN top * 0.08::DOUBLE ELSE 10.0::DOUBLE END AS slack FROM b)
    SELECT product_id, days, band_low, band_high, CAST(lowest_day AS VARCHAR) AS lowest_day, dashed, CASE WHEN bottom - slack <= 0 THEN CASE WHEN bottom > 0 THEN bottom * 0.5::DOUBLE ELSE 0.01::DOUBLE END ELSE bottom - slack END AS y_min, top + slack AS y_max FROM k""",
)
def chart_domains(spark, sf_dir):
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product_id"), (F.abs("c_acctbal") / 200).alias("target"))
    return V.chart_domain(_filled(spark, sf_dir), targets).withColumn("lowest_day", F.col("lowest_day").cast("string"))


@query("sparklines", f"WITH {FILLED}, g AS (SELECT product_id, count(*) AS points, min(low) AS least, max(low) AS most, arg_max(low, day) AS last FROM x GROUP BY product_id HAVING count(*) >= 2), k AS (SELECT *, CASE WHEN most > least THEN (most - least) * 0.12::DOUBLE WHEN most > 0 THEN most * 0.12::DOUBLE ELSE 1.0::DOUBLE END AS slack FROM g) SELECT product_id, points, least - slack AS y_min, most + slack AS y_max, last <= least AS ends_low FROM k")
def sparklines(spark, sf_dir):
    return V.sparklines(_filled(spark, sf_dir))


@query(
    "curve_pieces",
    f"""WITH {DAILY}, p AS (SELECT product_id, CAST(day - DATE '2024-01-01' AS DOUBLE) AS x, low AS y FROM d),
    n AS (SELECT product_id, x, y, coalesce(lag(x) OVER w, x) AS xa, coalesce(lag(y) OVER w, y) AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS xc, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS yc FROM p WINDOW w AS (PARTITION BY product_id ORDER BY x))
    SELECT product_id, x AS x0, y AS y0, x + (xb - xa) / 6 AS cx1, y + (yb - ya) / 6 AS cy1, xb - (xc - x) / 6 AS cx2, yb - (yc - y) / 6 AS cy2, xb AS x_end, yb AS y_end FROM n WHERE xb IS NOT NULL""",
)
def curve_pieces(spark, sf_dir):
    days = H.daily_series(readings(spark, sf_dir))
    return V.curve_pieces(days.select("product_id", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double").alias("x"), F.col("low").alias("y")))


@query(
    "store_history",
    f"""WITH {READINGS}, p AS (SELECT * FROM r WHERE coalesce(price, 0) <> 0), m AS (SELECT product_id, min(price) AS least, max(price) AS most FROM p GROUP BY product_id),
    l AS (SELECT product_id, store_id, count(*) AS points, string_agg(CAST(seq AS VARCHAR), ' ' ORDER BY ts, seq) AS path FROM p GROUP BY ALL)
    SELECT l.*, greatest(0.0::DOUBLE, least - CASE WHEN most > least THEN (most - least) * 0.12::DOUBLE ELSE most * 0.12::DOUBLE END) AS y_min, most + CASE WHEN most > least THEN (most - least) * 0.12::DOUBLE ELSE most * 0.12::DOUBLE END AS y_max FROM l JOIN m USING (product_id)""",
)
def store_history(spark, sf_dir):
    lines = V.store_history(readings(spark, sf_dir))
    return lines.select("product_id", "store_id", F.size("line").cast("long").alias("points"), F.array_join(F.transform("line", lambda p: p["seq"].cast("string")), " ").alias("path"), "y_min", "y_max")


# --- lists and cards

LISTED = f"""{BEST}, lo AS (SELECT product_id, min(price) AS lowest_price FROM r WHERE coalesce(price, 0) <> 0 GROUP BY product_id),
    d1 AS (SELECT product_id, arg_max(price, seq) AS price_24h FROM r WHERE coalesce(price, 0) <> 0 AND ts <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY product_id),
    pl AS (SELECT p_partkey AS product_id, p_brand AS query_id, p_name AS name, p_type AS brand, p_size % 7 = 0 AS archived, TIMESTAMP '2024-01-01' - INTERVAL 1 DAY * (p_partkey % 50) AS created_at, CASE WHEN p_partkey % 4 = 1 THEN p_size END AS place, current_price, current_price - lowest_price AS above_lowest, lowest_price,
    (current_price - price_24h) / price_24h * 100 AS percent_24h FROM part LEFT JOIN b ON b.product_id = p_partkey LEFT JOIN lo ON lo.product_id = p_partkey LEFT JOIN d1 ON d1.product_id = p_partkey)"""


def _listed(spark, sf_dir):
    r = readings(spark, sf_dir)
    summary = M.product_summary(r, H.current_offers(r), AS_OF).select("product_id", "current_price", "above_lowest", "lowest_price", ((F.col("current_price") - F.col("price_24h")) / F.col("price_24h") * 100).alias("percent_24h"))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") - F.make_interval(days=F.col("p_partkey").cast("int") % 50)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("query_id"), F.col("p_name").alias("name"), F.col("p_type").alias("brand"), (F.col("p_size") % 7 == 0).alias("archived"), created.alias("created_at"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_size")).alias("place"))
    return part.join(summary, "product_id", "left")


@query(
    "product_list",
    f"""WITH {LISTED}, k AS (SELECT * FROM pl WHERE NOT archived)
    SELECT 'manual' AS sorting, product_id, row_number() OVER (ORDER BY place NULLS LAST, created_at DESC, product_id)::BIGINT AS position FROM k
    UNION ALL SELECT 'drop', product_id, row_number() OVER (ORDER BY percent_24h NULLS LAST, product_id)::BIGINT FROM k
    UNION ALL SELECT 'price', product_id, row_number() OVER (ORDER BY current_price NULLS LAST, product_id)::BIGINT FROM k
    UNION ALL SELECT 'recent', product_id, row_number() OVER (ORDER BY created_at DESC, product_id)::BIGINT FROM k
    UNION ALL SELECT 'distance', product_id, row_number() OVER (ORDER BY above_lowest NULLS LAST, product_id)::BIGINT FROM k
    UNION ALL SELECT 'found', product_id, row_number() OVER (ORDER BY created_at DESC, product_id)::BIGINT FROM pl WHERE query_id = 'Brand#2' AND (contains(lower(name), 'red') OR contains(lower(brand), 'red'))""",
)
def product_list(spark, sf_dir):
    p = _listed(spark, sf_dir)
    out = V.product_list(p, "recent", " RED ", "Brand#2", archived=True).select(F.lit("found").alias("sorting"), "product_id", "position")
    for order in V.ORDERS:
        out = out.unionByName(V.product_list(p, order).select(F.lit(order).alias("sorting"), "product_id", "position"))
    return out


@query(
    "family_cards",
    f"""WITH {LISTED}, k AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, product_id)::BIGINT AS position FROM pl WHERE NOT archived)
    SELECT query_id, min(position) AS position, count(*) AS members, min(current_price) AS from_price, arg_min(product_id, struct_pack(p := current_price, o := position)) FILTER (current_price IS NOT NULL) AS from_product, coalesce(bool_or(current_price IS NOT NULL AND current_price <= coalesce(lowest_price, 'inf'::DOUBLE)), false) AS at_low FROM k GROUP BY query_id""",
)
def family_cards(spark, sf_dir):
    return V.family_cards(V.product_list(_listed(spark, sf_dir), "recent"))


@query("family_titles", "SELECT p_brand AS query_id, CASE WHEN p_brand IN ('Brand#3', 'Brand#4') THEN 'Busca ' || p_brand ELSE 'MacBook Pro de Linha ' || CASE WHEN CAST(substring(p_brand, 7) AS INT) % 2 = 1 THEN 'Ultra' ELSE 'MAX' END || substring(p_brand, 7) END AS title FROM part GROUP BY p_brand")
def family_titles(spark, sf_dir):
    n = F.col("p_partkey")
    number = F.substring("p_brand", 7, 9)
    line = F.concat(F.when(number.cast("int") % 2 == 1, "Ultra").otherwise("MAX"), number)
    # Spellings differ from listing to listing, lines from family to family; some families have nothing in common.
    alike = F.concat(F.lit("12 "), F.when(n % 3 == 0, "Macbook").when(n % 3 == 1, "MACBOOK").otherwise("MacBook"), F.lit(" Pro De linha "), line, F.lit(" 15 x"), n.cast("string"))
    alike = F.when(n % 5 == 0, F.replace(alike, F.lit("linha"), F.lit("Línha"))).otherwise(F.replace(alike, F.lit("linha"), F.lit("Linha")))
    own = F.concat(F.lit("item "), n.cast("string"), F.lit(" de "), n.cast("string"))
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("query_id"), n.alias("ordinal"), F.when(F.col("p_brand").isin("Brand#3", "Brand#4"), F.concat(F.lit("w"), own)).otherwise(alike).alias("name"))
    names = names.withColumn("name", F.when(F.col("query_id").isin("Brand#3", "Brand#4"), F.concat(F.lit("a"), F.col("ordinal").cast("string"))).otherwise(F.col("name")))
    asked = part.select(F.col("p_brand").alias("query_id"), F.concat(F.lit("busca "), F.col("p_brand")).alias("text")).distinct()
    return V.family_titles(names, asked)


@query(
    "card_offers",
    f"""WITH {BEST}, v AS (SELECT *, CASE store_id WHEN 'click' THEN price * 0.75::DOUBLE WHEN 'error' THEN 0.0::DOUBLE END AS discounted FROM o),
    e AS (SELECT *, coalesce(nullif(discounted, 0), price) AS cost FROM v WHERE price IS NOT NULL),
    k AS (SELECT product_id, arg_min(struct_pack(store_id, cost, price, discounted, ts), struct_pack(c := cost, p := price, s := seq)) AS b, max(price) AS dearest FROM e GROUP BY product_id),
    pr AS (SELECT * FROM r WHERE coalesce(price, 0) <> 0),
    d1 AS (SELECT product_id, arg_max(price, seq) AS price_24h FROM pr WHERE ts <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY product_id),
    la AS (SELECT pr.product_id, pr.price AS earlier_price FROM pr JOIN b ON pr.product_id = b.product_id AND store_id = best_store QUALIFY row_number() OVER (PARTITION BY pr.product_id ORDER BY seq DESC) = 2),
    s AS (SELECT product_id, CASE WHEN product_id % 3 > 0 THEN (current_price - price_24h) / price_24h * 100 END AS percent_24h, (current_price - earlier_price) / earlier_price * 100 AS percent_last FROM b LEFT JOIN d1 USING (product_id) LEFT JOIN la USING (product_id))
    SELECT k.product_id, k.b.store_id AS store_id, k.b.cost AS cost, k.b.price AS told_price, coalesce(k.b.discounted, 0) <> 0 AS has_discount, dearest, coalesce(percent_24h, percent_last) AS variation, CASE WHEN percent_24h IS NOT NULL THEN '24h' ELSE 'last' END AS variation_of, TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR > k.b.ts AS stale FROM k LEFT JOIN s USING (product_id)""",
)
def card_offers(spark, sf_dir):
    r = readings(spark, sf_dir)
    o = H.current_offers(r).withColumn("discounted", F.when(F.col("store_id") == "click", F.col("price") * 0.75).when(F.col("store_id") == "error", 0.0))
    best = M.best_offer(H.current_offers(r))
    day = M.variation_24h(r, best, AS_OF).select("product_id", F.when(F.col("product_id") % 3 > 0, F.col("percent")).alias("percent_24h"))
    last = M.last_variation(r, best).select("product_id", F.col("percent").alias("percent_last"))
    return V.card_offers(o, best.select("product_id").join(day, "product_id", "left").join(last, "product_id", "left"), AS_OF)


@query(
    "new_notices",
    f"""WITH {RUNNING}, u AS (SELECT seq AS opportunity_id, product_id, ts FROM w WHERE coalesce(price, 0) <> 0 AND coalesce(previous_price, 0) <> 0 AND price < previous_price AND (previous_price - price) / previous_price * 100 >= 5 AND seq % 3 > 0 AND seq % 5 > 0),
    t AS (SELECT count(*) AS total FROM u) SELECT opportunity_id, product_id, greatest(total - 3, 0) AS rest FROM u, t ORDER BY ts DESC, opportunity_id LIMIT 3""",
)
def new_notices(spark, sf_dir):
    found = O.price_drops(H.with_running(readings(spark, sf_dir))).withColumn("opportunity_id", F.col("seq")).withColumn("is_read", F.col("seq") % 3 == 0)
    return V.new_notices(found, found.filter("seq % 5 = 0").select("opportunity_id")).select("opportunity_id", "product_id", "rest")


@query("short_labels", "SELECT o_orderkey, CASE WHEN p >= 1000000 THEN 'R$ ' || replace(printf('%.1f', p / 1000000), '.', ',') || ' mi' WHEN p >= 1000 THEN 'R$ ' || replace(printf('%.1f', p / 1000), '.', ',') || ' mil' ELSE 'R$ ' || CAST(p AS BIGINT) END AS amount, strftime(o_orderdate, '%d') || '/' || ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'][month(o_orderdate)] AS day, 'R$ ' || replace(replace(replace(format('{:,}', CAST(p AS BIGINT)), ',', '.') || ',00', '..', '.'), ' ', '') AS money FROM (SELECT o_orderkey, o_orderdate, floor(o_totalprice) AS p FROM orders)")
def short_labels(spark, sf_dir):
    p = F.floor("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.short_money(p).alias("amount"), V.short_day(F.col("o_orderdate")).alias("day"), C.money(p).alias("money"))


# --- products and offers from round to round

CANDIDATES = "c AS (SELECT 'q' || (l_partkey % 40) AS query_id, 'k' || (l_partkey % 997) AS identity_key, 's' || (l_suppkey % 6) AS store_id, l_extendedprice AS price, 'item ' || l_partkey AS name, CAST(l_quantity AS BIGINT) AS score, l_orderkey * 10 + l_linenumber AS ordinal, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS ts FROM lineitem), pr AS (SELECT DISTINCT 'q' || (p_partkey % 40) AS query_id, 'k' || (p_partkey % 997) AS identity_key, 'p' || (p_partkey % 997) || '-' || (p_partkey % 40) AS product_id, p_partkey % 997 % 10 = 3 AS archived FROM part WHERE p_partkey % 997 % 3 = 0 AND p_partkey < 997)"
WRITTEN = f"""{CANDIDATES}, m AS (SELECT c.*, pr.product_id FROM c LEFT JOIN pr USING (query_id, identity_key) WHERE NOT coalesce(archived, false)),
    f AS (SELECT query_id, identity_key, score, ordinal FROM m WHERE product_id IS NULL QUALIFY row_number() OVER (PARTITION BY query_id, identity_key ORDER BY score DESC, ordinal) = 1),
    h AS (SELECT query_id, count(*) AS have FROM pr GROUP BY query_id),
    nw AS (SELECT f.query_id, identity_key, query_id || '/' || identity_key AS product_id FROM f LEFT JOIN h USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) <= 30 - coalesce(any_value(have) OVER (PARTITION BY query_id), 0)),
    t AS (SELECT m.* REPLACE (coalesce(m.product_id, nw.product_id) AS product_id) FROM m LEFT JOIN nw USING (query_id, identity_key)),
    rd AS (SELECT product_id, store_id, seq, price FROM t WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY CASE WHEN coalesce(price, 0) <> 0 THEN price ELSE 'inf'::DOUBLE END, ordinal) = 1)"""


def _written(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    c = line.select(text("q", F.col("l_partkey") % 40).alias("query_id"), text("k", F.col("l_partkey") % 997).alias("identity_key"), text("s", F.col("l_suppkey") % 6).alias("store_id"), F.col("l_extendedprice").alias("price"), text("item ", F.col("l_partkey")).alias("name"), F.col("l_quantity").cast("long").alias("score"), at.alias("ordinal"), at.alias("seq"), F.col("l_shipdate").alias("ts"))
    key = F.col("p_partkey") % 997
    products = part.filter((key % 3 == 0) & (F.col("p_partkey") < 997)).select(text("q", F.col("p_partkey") % 40).alias("query_id"), text("k", key).alias("identity_key"), F.concat(F.lit("p"), key.cast("string"), F.lit("-"), (F.col("p_partkey") % 40).cast("string")).alias("product_id"), (key % 10 == 3).alias("archived")).distinct()
    offers = products.select("product_id", F.lit("s1").alias("store_id"), F.lit(500.0).alias("price"), F.lit(None).cast("double").alias("previous_price"), F.lit(0).cast("long").alias("seq"), F.lit("2020-01-01").cast("timestamp_ntz").alias("ts"), F.lit("old").alias("title"), F.lit(True).alias("available"), F.lit(0).alias("absent_rounds"))
    return Y.write_round(c, products, offers, cap=30)


@query("round_products", f"WITH {WRITTEN} SELECT query_id, identity_key, product_id, archived FROM pr UNION ALL SELECT query_id, identity_key, product_id, false FROM nw")
def round_products(spark, sf_dir):
    return _written(spark, sf_dir).products.select("query_id", "identity_key", "product_id", "archived")


@query("round_offers", f"WITH {WRITTEN}, od AS (SELECT product_id, 's1' AS store_id FROM pr) SELECT coalesce(rd.product_id, od.product_id) AS product_id, coalesce(rd.store_id, od.store_id) AS store_id, coalesce(CASE WHEN rd.seq IS NOT NULL THEN rd.price END, 500.0::DOUBLE) AS price, CASE WHEN rd.seq IS NOT NULL AND od.product_id IS NOT NULL THEN 500.0::DOUBLE END AS previous_price, coalesce(rd.seq, 0) AS seq FROM rd FULL JOIN od ON rd.product_id = od.product_id AND rd.store_id = od.store_id")
def round_offers(spark, sf_dir):
    return _written(spark, sf_dir).offers.select("product_id", "store_id", "price", "previous_price", "seq")


@query("best_per_key", "SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) = 1")
def best_per_key(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return Y.best_per_key(i, ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query(
    "settled_offers",
    f"""WITH {CURRENT}, s AS (SELECT DISTINCT product_id, store_id FROM r WHERE ts >= TIMESTAMP '2024-01-30'), k AS (SELECT *, product_id % 11 = 0 AS manual, product_id % 4 AS absent_rounds FROM o),
    g AS (SELECT * FROM k WHERE NOT manual AND store_id IN (SELECT store_id FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.product_id = k.product_id AND s.store_id = k.store_id)),
    p AS (SELECT *, CASE WHEN product_id % 3 = 0 THEN price * 0.5::DOUBLE WHEN product_id % 3 = 1 THEN 0.0::DOUBLE END AS page FROM g)
    SELECT product_id, store_id, CASE WHEN coalesce(page, 0) <> 0 THEN page ELSE price END AS price, coalesce(page, 0) <> 0 AS available, CAST(CASE WHEN coalesce(page, 0) <> 0 THEN 0 ELSE absent_rounds + 1 END AS INTEGER) AS absent_rounds, CASE WHEN coalesce(page, 0) <> 0 THEN page END AS history_price, coalesce(page, 0) <> 0 AS found_again FROM p""",
)
def settled_offers(spark, sf_dir):
    r = readings(spark, sf_dir)
    o = H.current_offers(r).withColumn("manual", F.col("product_id") % 11 == 0).withColumn("absent_rounds", (F.col("product_id") % 4).cast("int"))
    seen = r.filter(F.col("ts") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    pages = o.filter("product_id % 3 < 2").select("product_id", "store_id", F.when(F.col("product_id") % 3 == 0, F.col("price") * 0.5).otherwise(0.0).alias("price"), F.lit(True).alias("available"))
    out = Y.settle_vanished(o, seen, pages, F.lit(1).cast("long"), AS_OF)
    return out.select("product_id", "store_id", "price", "available", "absent_rounds", "history_price", "found_again")


@query("page_price_source", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_retailprice WHEN p_size % 2 = 0 THEN p_retailprice * 2 END AS price, CASE WHEN p_size % 3 > 0 THEN 'plain' WHEN p_size % 2 = 0 THEN 'rendered' ELSE 'none' END AS read_from FROM part")
def page_price_source(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    plain = part.select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("price"))
    return Y.page_price(plain, part.filter("p_size % 2 = 0").select("p_partkey", (F.col("p_retailprice") * 2).alias("price")), ["p_partkey"])


HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '')"


@query("manual_offers", f"WITH l AS (SELECT page_id AS product_id, url, {HOST} AS h, CASE WHEN page_id % 3 > 0 THEN page_id * 1.5::DOUBLE ELSE 0.0::DOUBLE END AS p FROM pages), s AS (SELECT h, min(page_id) AS store_id FROM (SELECT page_id, {HOST} AS h FROM pages WHERE page_id % 4 = 0) GROUP BY h), j AS (SELECT l.*, s.store_id, CASE WHEN s.store_id IS NULL THEN 'unknown_store' WHEN p = 0 THEN 'no_price' ELSE 'ok' END AS result FROM l LEFT JOIN s USING (h)) SELECT product_id, result, CASE WHEN result = 'ok' THEN store_id END AS store_id, CASE WHEN result = 'ok' THEN p END AS price, CASE WHEN result = 'ok' THEN 100 END AS score FROM j")
def manual_offers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    captured = pages.select(F.col("page_id").alias("product_id"), "url", F.when(F.col("page_id") % 3 > 0, F.col("page_id") * 1.5).otherwise(0.0).alias("price"), F.lit(True).alias("available"))
    host = P.host_of(F.col("url"))
    stores = pages.filter("page_id % 4 = 0").select(F.col("page_id").alias("store_id"), F.concat(F.lit("https://www."), host).alias("origin"))
    return Y.manual_offers(pages.select(F.col("page_id").alias("product_id"), "url"), stores, captured).select("product_id", "result", "store_id", "price", "score")


@query("coupon_checks_due", f"WITH {CURRENT}, c AS (SELECT *, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 13 HOUR ELSE TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR END AS checked_at FROM o), d AS (SELECT * FROM c WHERE coalesce(price, 0) <> 0 AND (checked_at IS NULL OR checked_at <= TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR) QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY checked_at IS NOT NULL, price, seq) <= 3) SELECT product_id, store_id, seq, price FROM d ORDER BY checked_at IS NOT NULL, price, seq LIMIT 8")
def coupon_checks_due(spark, sf_dir):
    now = F.lit(AS_OF).cast("timestamp_ntz")
    o = H.current_offers(readings(spark, sf_dir)).withColumn("checked_at", F.when(F.col("seq") % 3 == 1, now - F.make_interval(hours=F.lit(13))).when(F.col("seq") % 3 == 2, now - F.make_interval(hours=F.lit(2))))
    return Y.coupon_checks(o, AS_OF).select("product_id", "store_id", "seq", "price")


@query("cash_rule", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN NULL ELSE floor(l_tax * 100) END AS percent, CASE WHEN l_discount > 0.05 THEN floor(l_extendedprice) ELSE l_extendedprice END AS cost FROM lineitem")
def cash_rule(spark, sf_dir):
    condition = F.when(F.col("l_returnflag") == "R", "pix").when(F.col("l_linestatus") == "F", "à vista").when(F.col("l_returnflag") == "A", "boleto")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Y.already_cash(condition, F.floor(F.col("l_tax") * 100).cast("double")).alias("percent"), V.offer_price(F.when(F.col("l_discount") > 0.05, F.floor("l_extendedprice").cast("double")).otherwise(0.0), F.col("l_extendedprice")).alias("cost"))


# --- runs


@query("failure_streaks", f"WITH {READINGS}, t AS (SELECT store_id || (product_id % 20) AS store_id, seq, price > 20 AS ok FROM r), l AS (SELECT store_id, max(seq) FILTER (ok) AS last FROM t GROUP BY store_id) SELECT t.store_id, count(*) FILTER (last IS NULL OR seq > last) AS failures FROM t JOIN l USING (store_id) GROUP BY t.store_id")
def failure_streaks(spark, sf_dir):
    return Y.failure_streaks(readings(spark, sf_dir).select(F.concat("store_id", (F.col("product_id") % 20).cast("string")).alias("store_id"), F.col("seq").alias("ordinal"), (F.col("price") > 20).alias("ok")))


@query("run_counters", f"WITH {READINGS}, d AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS round FROM r), p AS (SELECT round, count(*) AS n FROM (SELECT product_id, min(round) AS round FROM d GROUP BY 1) GROUP BY 1), q AS (SELECT round, count(*) AS n FROM (SELECT product_id, store_id, min(round) AS round FROM d GROUP BY ALL) GROUP BY 1) SELECT d.round, count(*) AS readings, count(*) FILTER (coalesce(price, 0) <> 0) AS priced, count(DISTINCT store_id) AS stores, coalesce(any_value(p.n), 0) AS new_products, coalesce(any_value(q.n), 0) AS new_offers FROM d LEFT JOIN p USING (round) LEFT JOIN q USING (round) GROUP BY d.round")
def run_counters(spark, sf_dir):
    return Y.run_counters(readings(spark, sf_dir), F.to_date("ts").cast("string"))


@query("registry_counts", f"WITH {CURRENT} SELECT 'store' AS kind, store_id AS id, count(*) AS count FROM o GROUP BY store_id UNION ALL SELECT 'query', p_brand, count(*) FILTER (p_size % 7 <> 0) FROM part GROUP BY p_brand")
def registry_counts(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), (F.col("p_size") % 7 == 0).alias("archived"))
    return Y.registry_counts(H.current_offers(readings(spark, sf_dir)), products)


@query("schedule", "WITH s AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 MINUTE * CAST(o_orderkey % 1440 AS INTEGER) AS as_of, CASE o_custkey % 3 WHEN 0 THEN ['20:30', '08:00'] WHEN 1 THEN ['12:15'] ELSE [] END AS slots, CASE o_custkey % 4 WHEN 0 THEN NULL ELSE o_orderdate END AS last, CAST(o_custkey % 5 * 60 AS INTEGER) AS minutes FROM orders), t AS (SELECT *, list_filter(list_transform(list_sort(slots), lambda x: CAST(CAST(CAST(as_of AS DATE) AS VARCHAR) || ' ' || x || ':00' AS TIMESTAMP)), lambda t: t > as_of) AS ahead FROM s) SELECT o_orderkey, coalesce(ahead[1], CAST(CAST(CAST(as_of AS DATE) + 1 AS VARCHAR) || ' ' || list_sort(slots)[1] || ':00' AS TIMESTAMP)) AS next_at, minutes > 0 AND coalesce(as_of - last >= INTERVAL 1 MINUTE * minutes, true) AS due FROM t")
def schedule(spark, sf_dir):
    slots = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("20:30"), F.lit("08:00"))).when(F.col("o_custkey") % 3 == 1, F.array(F.lit("12:15"))).otherwise(F.array().cast("array<string>"))
    as_of = F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    last = F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderdate").cast("timestamp_ntz"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", slots.alias("slots"), as_of.alias("as_of"), last.alias("last"), (F.col("o_custkey") % 5 * 60).cast("int").alias("minutes"))
    return o.select("o_orderkey", Y.next_slot(F.col("slots"), F.col("as_of")).alias("next_at"), Y.round_due(F.col("last"), F.col("minutes"), F.col("as_of")).alias("due"))


def _state(spark, sf_dir):
    part, r = table(spark, sf_dir, "part"), readings(spark, sf_dir)
    products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("query_id"))
    return Y.State(products.select("query_id").distinct(), products, H.current_offers(r), O.price_drops(H.with_running(r)))


@query(
    "deleted_queries",
    f"""WITH {RUNNING}, o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY seq DESC) = 1), gone AS (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#7')),
    u AS (SELECT product_id FROM w WHERE coalesce(price, 0) <> 0 AND coalesce(previous_price, 0) <> 0 AND price < previous_price AND (previous_price - price) / previous_price * 100 >= 5)
    SELECT 'queries' AS kind, count(DISTINCT p_brand) AS left_over FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#7') UNION ALL SELECT 'products', count(*) FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#7')
    UNION ALL SELECT 'offers', count(*) FROM o WHERE product_id NOT IN (SELECT p_partkey FROM gone) UNION ALL SELECT 'opportunities', count(*) FROM u WHERE product_id NOT IN (SELECT p_partkey FROM gone) UNION ALL SELECT 'history', count(*) FROM r
    UNION ALL SELECT 'store_offers', count(*) FROM o WHERE store_id <> 'click' UNION ALL SELECT 'stores', count(DISTINCT store_id) FROM r WHERE store_id <> 'click'""",
)
def deleted_queries(spark, sf_dir):
    state = _state(spark, sf_dir)
    left = Y.without_queries(state, spark.createDataFrame([("Brand#1",), ("Brand#7",)], "query_id string"))
    r = readings(spark, sf_dir)
    stores, offers = Y.without_stores(r.select("store_id").distinct(), state.offers, spark.createDataFrame([("click",)], "store_id string"))
    count = lambda kind, df: df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(kind).alias("kind"), "left_over")
    out = count("queries", left.queries)
    for kind, df in (("products", left.products), ("offers", left.offers), ("opportunities", left.opportunities), ("history", r), ("store_offers", offers), ("stores", stores)):
        out = out.unionByName(count(kind, df))
    return out


@query("target_cascade", "SELECT p_partkey AS product_id, CASE WHEN p_brand IN ('Brand#1', 'Brand#7') AND p_size % 5 <> 0 THEN CASE WHEN p_brand = 'Brand#1' THEN 99.5::DOUBLE END ELSE p_retailprice END AS target FROM part")
def target_cascade(spark, sf_dir):
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("query_id"), F.col("p_retailprice").alias("target"), (F.col("p_size") % 5 == 0).alias("own_target"))
    return Y.with_target(products, spark.createDataFrame([("Brand#1", 99.5), ("Brand#7", None)], "query_id string, target double")).select("product_id", "target")


@query("rolling_lows", f"WITH {READINGS} SELECT product_id, seq, price, min(price) OVER (PARTITION BY product_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS low FROM r WHERE coalesce(price, 0) <> 0")
def rolling_lows(spark, sf_dir):
    return Y.rolling_low(readings(spark, sf_dir), 7).select("product_id", "seq", "price", "low")


# --- crawl decisions


@query("fallback_decisions", "WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 503 WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, page_id % 13 <> 0 AS allowed, page_id % 2 = 0 AS respects FROM pages) SELECT page_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'take' WHEN NOT allowed THEN 'report' WHEN status = 503 AND respects THEN 'refused' WHEN status = 404 THEN 'wrong_address' ELSE 'browser' END AS decision FROM p")
def fallback_decisions(spark, sf_dir):
    status = F.when(F.col("page_id") % 11 == 0, None).when(F.col("page_id") % 7 == 0, 503).when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    pages = table(spark, sf_dir, "pages").select("page_id", status.alias("status"), P.refusal(status, F.col("html")).alias("refusal"))
    return pages.select("page_id", W.fallback(F.col("refusal"), F.col("status"), F.col("page_id") % 13 != 0, F.col("page_id") % 2 == 0).alias("decision"))


@query("access_paths", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 5 <> 0 THEN 'forbidden' WHEN s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 THEN 'plain' WHEN s_suppkey % 5 <> 0 AND s_nationkey % 6 >= 3 THEN 'plain_again' WHEN s_suppkey % 2 = 0 THEN 'sitemap' WHEN s_suppkey % 5 = 0 THEN 'typed' ELSE 'browser' END AS path FROM supplier")
def access_paths(spark, sf_dir):
    n = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (n % 7 != 0).alias("robots_allow"), (n % 5 == 0).alias("typed"), (n % 3 == 0).alias("needs_browser"), (F.col("s_nationkey") % 6).alias("plain_items"), (n % 2 == 0).alias("sitemap"))
    return s.select("s_suppkey", W.access_path(s).alias("path"))


@query("typed_results", "WITH i AS (SELECT p_brand AS store_id, p_name FROM part) SELECT store_id, count(*) AS items, count(*) FILTER (contains(p_name, 'red') OR contains(p_name, 'ring')) AS related, count(*) FILTER (contains(p_name, 'red') OR contains(p_name, 'ring')) / count(*) AS relevance, count(*) FILTER (contains(p_name, 'red') OR contains(p_name, 'ring')) / count(*) >= 0.2 AS is_result FROM i GROUP BY store_id")
def typed_results(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("store_id"), "p_name")
    return W.typed_result_counts(W.relevance(items, ["store_id"], F.array(F.lit("Red"), F.lit("ring"), F.lit("of")), F.col("p_name")))


TRIED = """i AS (SELECT l_suppkey AS store_id, 'p' || l_linenumber AS pattern, l_linenumber AS ordinal, ['jsonld', 'microdata', 'state', 'blocks', 'selectors'][1 + l_linenumber % 5] AS strategy, l_discount > 0.02 AS priced, l_tax > 0.02 AS linked, l_quantity > 40 AS coded, l_extendedprice AS p, l_partkey FROM lineitem),
    t AS (SELECT store_id, pattern, ordinal, any_value(strategy) AS strategy, count(*) AS items, count(*) FILTER (priced) AS priced, count(*) FILTER (priced AND linked) AS linked, count(*) FILTER (priced AND coded) AS with_code, count(*) FILTER (l_partkey % 4 < 3) / count(*) AS relevance, store_id % 9 = 0 AS home FROM i GROUP BY ALL),
    c AS (SELECT *, CASE WHEN home THEN 0.0::DOUBLE ELSE CASE WHEN linked > 0 THEN linked ELSE priced END * relevance * CASE strategy WHEN 'jsonld' THEN 1.6::DOUBLE WHEN 'microdata' THEN 1.4::DOUBLE WHEN 'selectors' THEN 1.2::DOUBLE WHEN 'state' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END END AS points FROM t)"""


@query(
    "store_diagnosis",
    f"""WITH {TRIED}, b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY points DESC, ordinal) = 1), v AS (SELECT *, store_id % 5 = 0 AS forbidden, strategy IN ('jsonld', 'microdata', 'state') AS structured FROM b)
    SELECT store_id, pattern, points, CASE WHEN points <= 0 THEN 'incompatible' WHEN priced >= 3 AND structured AND NOT forbidden THEN 'compatible' ELSE 'partial' END AS verdict,
    array_to_string(list_filter([CASE WHEN NOT structured THEN 'no_structured_data' END, CASE WHEN with_code = 0 THEN 'no_product_codes' END, CASE WHEN priced < items * 0.6::DOUBLE THEN 'few_prices' END, CASE WHEN forbidden THEN 'robots' END, CASE WHEN strategy = 'blocks' THEN 'layout_only' END], lambda x: x IS NOT NULL), ',') AS limits FROM v""",
)
def store_diagnosis(spark, sf_dir):
    names = F.array(*map(F.lit, ("jsonld", "microdata", "state", "blocks", "selectors")))
    i = table(spark, sf_dir, "lineitem").withColumn("pattern", F.concat(F.lit("p"), F.col("l_linenumber").cast("string")))
    priced = F.col("l_discount") > 0.02
    t = i.groupBy(F.col("l_suppkey").alias("store_id"), "pattern", F.col("l_linenumber").alias("ordinal")).agg(F.count(F.lit(1)).alias("items"), F.count_if(priced).alias("priced"), F.count_if(priced & (F.col("l_tax") > 0.02)).alias("linked"), F.count_if(priced & (F.col("l_quantity") > 40)).alias("with_code"), (F.count_if(F.col("l_partkey") % 4 < 3) / F.count(F.lit(1))).alias("relevance"))
    t = t.withColumn("strategy", F.get(names, F.col("ordinal") % 5)).withColumn("home", F.col("store_id") % 9 == 0)
    forbid = t.select("store_id").filter("store_id % 5 = 0").distinct()
    return W.diagnose(W.search_candidates(t), forbid)


@query("entered_stores", r"WITH e AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN 'localhost/' || page_id ELSE '  ' END AS entry, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(html, '<title>([^<&|:–—-]*)', 1) AS head FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN scheme || '://' || h WHEN 1 THEN 'https://' || h END AS origin, CASE WHEN page_id % 4 < 2 THEN h END AS host, CASE WHEN trim(head) <> '' AND length(trim(head)) < 40 THEN trim(head) ELSE upper(substring(regexp_replace(h, '^www\.', ''), 1, 1)) || substring(string_split(regexp_replace(h, '^www\.', ''), '.')[1], 2) END AS name FROM e")
def entered_stores(spark, sf_dir):
    url, n = F.col("url"), F.col("page_id") % 4
    entry = F.when(n == 0, url).when(n == 1, F.regexp_replace(url, "^[a-z]+://", "")).when(n == 2, F.concat(F.lit("localhost/"), F.col("page_id").cast("string"))).otherwise("  ")
    title = F.regexp_extract("html", "<title>([^<&|:–—-]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", W.entered_store(entry).alias("s"), W.store_name(F.lit(""), title, F.lower(F.parse_url("url", F.lit("HOST")))).alias("name"))
    return p.select("page_id", "s.origin", "s.host", "name")


@query("library_stores", "SELECT s_suppkey AS library_id, s_suppkey % 2 = 0 AS is_registered FROM supplier WHERE contains(lower(s_name), '#00000000') OR contains('loja' || s_suppkey || '.com.br', '#00000000')")
def library_stores(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("library_id"), F.translate("s_name", "ue", "úé").alias("name"), F.concat(F.lit("www.loja"), F.col("s_suppkey").cast("string"), F.lit(".com.br")).alias("host"))
    own = s.filter("library_id % 2 = 0").select(F.concat(F.lit("https://"), F.col("host"), F.lit("/")).alias("origin"))
    return W.library_search(s, " SÚPPLIER#00000000 ", own).select("library_id", "is_registered")


@query("link_disclosure", "SELECT bool_or(s_suppkey % 6 = 0) AS disclose, count(*) FILTER (s_suppkey % 6 = 0) AS stores FROM supplier")
def link_disclosure(spark, sf_dir):
    none = F.lit(None).cast("string")
    n = F.col("s_suppkey")
    a = F.struct(F.when(n % 2 == 0, "suffix").otherwise("network").alias("kind"), none.alias("key"), F.when(n % 3 == 0, "?tag=x").alias("value"), none.alias("template"), none.alias("merchant"), none.alias("affiliate"), none.alias("ref"))
    return W.needs_disclosure(table(spark, sf_dir, "supplier").select(P.affiliate_usable(a).alias("usable")))


@query("paged_scan", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) SELECT CAST(floor(place / 1000) AS BIGINT) AS page, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS rows FROM n GROUP BY 1")
def paged_scan(spark, sf_dir):
    return W.paged(table(spark, sf_dir, "orders"), "o_orderkey", per_task=4000)


@query("plain_again", "WITH l AS (SELECT l_suppkey AS store_id, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.05) AS plain_items FROM lineitem GROUP BY 1) SELECT *, plain_items >= 3 AS plain_again FROM l")
def plain_again(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store_id"), F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).alias("price"), F.when(F.col("l_tax") > 0.05, "u").alias("url"))
    return W.cheap_enough(l)


# --- written money


@query("price_conditions", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'pix' WHEN 1 THEN 'à vista' WHEN 2 THEN 'boleto' WHEN 4 THEN 'transferência' END AS condition FROM part")
def price_conditions(spark, sf_dir):
    after = F.element_at(F.array(*map(F.lit, (" no Pix agora", " à vista", " no boleto bancário", " com 10% de desconto no pix", " por transferencia", " em 10x"))), F.col("p_size") % 6 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 6 == 4, C.price_condition(F.lit(" por transferência"))).otherwise(C.price_condition(after)).alias("condition"))


@query("instalment_plans", "WITH p AS (SELECT p_partkey, p_size, floor(p_retailprice / 10) * 10 AS price FROM part) SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 10 WHEN p_size % 4 < 3 THEN 12 END AS times, CASE WHEN p_size % 4 < 2 THEN price / 10 WHEN p_size % 4 = 2 THEN price / 10 END AS amount, CASE WHEN p_size % 4 < 2 THEN true WHEN p_size % 4 = 2 THEN false END AS no_interest FROM p")
def instalment_plans(spark, sf_dir):
    price = F.floor(F.col("p_retailprice") / 10) * 10.0
    tenth = F.concat((price / 10).cast("int").cast("string"), F.lit(",00"))
    apart = F.when(F.col("p_size") % 4 == 0, " no cartão da loja ou").otherwise(" ou")  # "sem juros" counts within 30 characters
    text = F.when(F.col("p_size") % 4 < 2, F.concat(F.lit("ou 12x de R$ "), tenth, apart, F.lit(" 10x de "), tenth, F.lit(" sem juros"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("12 x R$ "), tenth, F.lit(" com juros, 2x de R$ 1,00"))).otherwise(F.lit("1x de R$ 10,00 ou 99x de R$ 0,01"))
    best = table(spark, sf_dir, "part").select("p_partkey", C.best_instalments(text, price).alias("b"))
    return best.select("p_partkey", "b.times", "b.amount", "b.no_interest")


@query("written_numbers", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 2 THEN CAST(p_size * 1000 AS DOUBLE) ELSE NULL END AS number, p_size % 4 = 3 AS is_document FROM part")
def written_numbers(spark, sf_dir):
    n = F.col("p_size")
    text = F.when(n % 4 == 0, "0").when(n % 4 == 1, F.concat(n.cast("string"), F.lit(",5 %"))).when(n % 4 == 2, F.concat(n.cast("string"), F.lit(".000"))).otherwise(F.lit("CNPJ: a definir"))
    return table(spark, sf_dir, "part").select("p_partkey", C.read_number(text).alias("number"), C.is_document(text).alias("is_document"))


@query("kept_discounts", "WITH b AS (SELECT p_partkey AS product_id, floor(p_retailprice / 10) * 10 AS p, p_size % 10 AS pc, CASE WHEN p_size % 3 = 0 AND p_size % 5 > 0 THEN 10 ELSE 0 END AS cash, p_size % 4 > 0 AS page FROM part), c AS (SELECT *, CASE WHEN page THEN round(p * (1 - pc / 100) * 100) * (100 - cash) / 100 END AS cents FROM b) SELECT product_id, CASE WHEN page THEN pc END AS coupon, CAST(CASE WHEN round(cents) < p * 100 THEN round(cents) END AS BIGINT) AS discounted_cents FROM c")
def kept_discounts(spark, sf_dir):
    n = F.col("p_size")
    part = table(spark, sf_dir, "part").withColumn("product_id", F.col("p_partkey")).withColumn("store_id", F.lit("s"))
    offers = part.select("product_id", "store_id", (F.floor(F.col("p_retailprice") / 10) * 10.0).alias("price"))
    coupons = F.array(F.struct(F.lit("percent").alias("kind"), (n % 10).cast("double").alias("value")), F.struct(F.lit("amount").alias("kind"), F.lit(5.0).alias("value")))
    pages = part.filter("p_size % 4 > 0").select("product_id", "store_id", coupons.alias("coupons"), F.when(n % 3 == 0, 10.0).alias("cash_percent"), F.when(n % 5 == 0, "pix").alias("condition"))
    return Y.keep_discounts(offers, pages).select("product_id", F.col("coupon.value").cast("int").alias("coupon"), F.round(F.col("discounted") * 100).cast("long").alias("discounted_cents"))


@query("robots_search", "SELECT p_partkey AS host, p_size % 5 < 3 AS forbids_search FROM part")
def robots_search(spark, sf_dir):
    path = F.get(F.array(*map(F.lit, ("/", "/search?q=", "/s", "/sale", "/x"))), F.col("p_size") % 5)
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("host"), F.lit("disallow").alias("kind"), path.alias("path"))
    return P.forbids_search(rules.unionByName(rules.select("host", F.lit("allow").alias("kind"), F.lit("/").alias("path"))))


@query("sitemap_indexes", "WITH x AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN list_transform(range(1, least(5, page_id % 9) + 1), lambda i: url || '/' || i) ELSE [] END AS l FROM pages) SELECT page_id, array_to_string(l, ' ') AS children FROM x")
def sitemap_indexes(spark, sf_dir):
    items = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 9).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("<loc>"), F.col("url"), F.lit("/"), i.cast("string"), F.lit("</loc>"))).otherwise(F.when(F.col("page_id") % 2 == 0, "<sitemapIndex>").otherwise("<urlset>")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(P.sitemap_children(F.array_join(items, "")), " ").alias("children"))


@query("sql_functions", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 50.0::DOUBLE ELSE 90.0::DOUBLE END AS with_coupon, greatest(100 * 900.0::DOUBLE / p_retailprice, 4.0::DOUBLE) AS width, CASE WHEN p_size % 2 = 0 THEN 'great' ELSE 'poor' END AS rating, 'mod:samsung:rf' || (1000 + p_partkey) || ':::' AS identity_key, p_size % 2 = 0 AS same FROM part")
def sql_functions(spark, sf_dir):
    from precioscope.functions.extract import spread
    from precioscope.functions.registry import register

    register(spark)
    view = f"sql_functions_part_{abs(hash(sf_dir))}"
    spread(table(spark, sf_dir, "part")).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT p_partkey, watch_with_coupon(100D, CASE WHEN p_size % 2 = 0 THEN 'amount' ELSE 'percent' END, CASE WHEN p_size % 2 = 0 THEN 50D ELSE 10D END) AS with_coupon,
        watch_bar_width(900D, p_retailprice) AS width, watch_rating(CASE WHEN p_size % 2 = 0 THEN 0.95D ELSE 0.1D END) AS rating, watch_identity_key(concat('Geladeira Samsung RF', 1000 + p_partkey)) AS identity_key,
        watch_same_product(concat('Geladeira Samsung RF', 1000 + p_partkey), concat('geladeira samsung rf ', 1000 + p_partkey + p_size % 2)) AS same FROM {view}""")
