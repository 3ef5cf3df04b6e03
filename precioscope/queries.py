"""Queries of the price-intelligence operators over the driver's tables, and their SQL.

events stand for price readings (user: product, type: store, event_id: arrival), part for products,
documents and pages for listing titles and captured pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precioscope.functions import text as X
from precioscope.operators import crawl as W
from precioscope.operators import history as H
from precioscope.operators import opportunity as O
from precioscope.operators import scope
from precioscope.operators import score as S
from precioscope.operators import summary as M
from precioscope.operators import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-31 18:00:00"
QUERY_WORDS = ["the", "erbleen", "thonation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("product_id"), F.col("event_type").alias("store_id"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("price"), (k % 10 != 0).alias("available"))


READINGS = """r AS (SELECT user_id AS product_id, event_type AS store_id, event_id AS seq, ts, value AS price,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 <> 0 AS available FROM events)"""
RUNNING = f"""{READINGS}, w AS (SELECT *,
    last_value(CASE WHEN coalesce(price, 0) <> 0 THEN price END IGNORE NULLS) OVER (PARTITION BY product_id, store_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_price,
    min(CASE WHEN coalesce(price, 0) <> 0 THEN price END) OVER (PARTITION BY product_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS minimum_before FROM r)"""
CURRENT = f"""{READINGS}, o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY seq DESC) = 1)"""
BEST = f"""{CURRENT}, b AS (SELECT product_id, arg_min(store_id, struct_pack(p := price, s := seq)) AS best_store, min(price) AS current_price, count(*) AS stores FROM o WHERE coalesce(price, 0) <> 0 AND coalesce(available, true) GROUP BY product_id)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# --- history


@query(
    "history_change_points",
    f"""WITH {READINGS}, m AS (SELECT *, CASE WHEN row_number() OVER p = 1 OR price IS DISTINCT FROM lag(price) OVER p OR available IS DISTINCT FROM lag(available) OVER p THEN 1 ELSE 0 END AS starts
    FROM r WINDOW p AS (PARTITION BY product_id, store_id ORDER BY seq)),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY product_id, store_id ORDER BY seq) AS island FROM m),
    c AS (SELECT *, max(ts) OVER (PARTITION BY product_id, store_id, island) AS confirmed_at, count(*) OVER (PARTITION BY product_id, store_id, island) AS confirmations FROM i)
    SELECT product_id, store_id, seq, ts, price, available, confirmed_at, confirmations FROM c WHERE starts = 1""",
)
def history_change_points(spark, sf_dir):
    return H.change_points(readings(spark, sf_dir))


@query("price_drops", f"WITH {RUNNING} SELECT 'price_drop' AS kind, product_id, store_id, seq, ts, price, previous_price AS reference_price, -((previous_price - price) / previous_price * 100) AS percent FROM w WHERE coalesce(price, 0) <> 0 AND coalesce(previous_price, 0) <> 0 AND price < previous_price AND (previous_price - price) / previous_price * 100 >= 5")
def price_drops(spark, sf_dir):
    return O.price_drops(H.with_running(readings(spark, sf_dir)))


@query("new_all_time_lows", f"WITH {RUNNING} SELECT 'all_time_low' AS kind, product_id, store_id, seq, ts, price, minimum_before AS reference_price, -((minimum_before - price) / minimum_before * 100) AS percent FROM w WHERE coalesce(price, 0) <> 0 AND price < minimum_before")
def new_all_time_lows(spark, sf_dir):
    return O.new_lows(H.with_running(readings(spark, sf_dir)))


def targets(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product_id"), (F.abs("c_acctbal") / 200).alias("target"))


@query("below_target", f"WITH {READINGS} SELECT 'below_target' AS kind, product_id, arg_min(store_id, seq) AS store_id, min(seq) AS seq, arg_min(ts, seq) AS ts, arg_min(price, seq) AS price, any_value(abs(c_acctbal) / 200) AS reference_price, CAST(NULL AS DOUBLE) AS percent FROM r JOIN customer ON c_custkey = product_id WHERE c_acctbal <> 0 AND coalesce(price, 0) <> 0 AND price <= abs(c_acctbal) / 200 GROUP BY product_id")
def below_target(spark, sf_dir):
    return O.below_target(readings(spark, sf_dir), targets(spark, sf_dir))


@query("current_offers", f"WITH {CURRENT} SELECT product_id, store_id, seq, ts, price, available FROM o")
def current_offers(spark, sf_dir):
    return H.current_offers(readings(spark, sf_dir))


@query(
    "best_between_stores",
    f"""WITH {CURRENT}, g AS (SELECT product_id, count(*) AS offers, arg_min(store_id, struct_pack(p := price, s := seq)) AS store_id, min(price) AS price, arg_max(store_id, struct_pack(p := price, s := seq)) AS dear_store, max(price) AS dear_price
    FROM o WHERE coalesce(price, 0) <> 0 AND coalesce(available, true) GROUP BY product_id)
    SELECT *, (dear_price - price) / dear_price AS spread FROM g WHERE offers >= 2 AND (dear_price - price) / dear_price >= 0.05""",
)
def best_between_stores(spark, sf_dir):
    return O.best_between_stores(H.current_offers(readings(spark, sf_dir)))


DAILY = f"""{READINGS}, d AS (SELECT product_id, CAST(ts AS DATE) AS day, min(price) AS low, max(price) AS high, arg_min(store_id, struct_pack(p := price, t := ts, s := seq)) AS low_store, count(*) AS readings FROM r WHERE coalesce(price, 0) <> 0 GROUP BY ALL)"""


@query("daily_series", f"WITH {DAILY} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM d")
def daily_series(spark, sf_dir):
    return H.daily_series(readings(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(
    "daily_series_filled",
    f"""WITH {DAILY}, a AS (SELECT max(ts) AS as_of FROM r), f AS (SELECT product_id, min(day) AS first_day, any_value(as_of) AS as_of FROM d, a GROUP BY product_id),
    s AS (SELECT *, CAST(first_day AS TIMESTAMP) + INTERVAL 12 HOUR > as_of - INTERVAL 14 DAY AS late FROM f),
    c AS (SELECT product_id, CAST(unnest(generate_series(CASE WHEN late THEN CAST(first_day AS TIMESTAMP) ELSE date_trunc('day', as_of - INTERVAL 14 DAY) END, CAST(CASE WHEN late AND hour(as_of) < 12 THEN CAST(as_of AS DATE) - 1 ELSE CAST(as_of AS DATE) END AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s),
    j AS (SELECT c.product_id, c.day, low, high, low_store, readings FROM c LEFT JOIN d USING (product_id, day)),
    x AS (SELECT product_id, day, last_value(low IGNORE NULLS) OVER w AS low, last_value(high IGNORE NULLS) OVER w AS high, last_value(low_store IGNORE NULLS) OVER w AS low_store, coalesce(readings, 0) AS readings, readings IS NULL AS estimated FROM j WINDOW w AS (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM x WHERE low IS NOT NULL""",
)
def daily_series_filled(spark, sf_dir):
    r = readings(spark, sf_dir)
    return H.filled_series(r, F.lit(r.agg(F.max("ts")).first()[0]), 15).withColumn("day", F.col("day").cast("string"))


@query("lowest_ever", f"WITH {READINGS}, p AS (SELECT * FROM r WHERE coalesce(price, 0) <> 0) SELECT product_id, min(price) AS lowest_price, arg_min(ts, struct_pack(p := price, s := seq)) AS lowest_at, arg_min(store_id, struct_pack(p := price, s := seq)) AS lowest_store FROM p GROUP BY product_id")
def lowest_ever(spark, sf_dir):
    return H.lowest_ever(readings(spark, sf_dir))


@query(
    "price_assessment",
    f"""WITH {BEST}, x AS (SELECT r.product_id, current_price, CAST(round(r.price * 100) AS BIGINT) AS cents, r.price > current_price AS dearer, r.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY - INTERVAL 80 DAY AS recent FROM r JOIN b USING (product_id) WHERE coalesce(r.price, 0) <> 0),
    g AS (SELECT product_id, current_price, count(*) FILTER (recent) AS n90, count(*) FILTER (recent AND dearer) AS d90, count(*) AS n, count(*) FILTER (dearer) AS d, sum(cents) FILTER (recent) AS c90, sum(cents) AS c FROM x GROUP BY ALL),
    h AS (SELECT product_id, current_price, CASE WHEN n90 < 3 THEN n ELSE n90 END AS base, CASE WHEN n90 < 3 THEN d ELSE d90 END AS dearer, CASE WHEN n90 < 3 THEN c ELSE c90 END / CASE WHEN n90 < 3 THEN n ELSE n90 END / 100 AS mean FROM g)
    SELECT *, (current_price - mean) / mean * 100 AS from_mean_percent, dearer / base AS share_dearer, CASE WHEN dearer / base >= 0.9 THEN 'great' WHEN dearer / base >= 0.6 THEN 'good' WHEN dearer / base >= 0.3 THEN 'normal' ELSE 'poor' END AS rating FROM h WHERE base >= 3""",
)
def price_assessment(spark, sf_dir):
    r = readings(spark, sf_dir)
    return M.price_assessment(r, M.best_offer(H.current_offers(r)), AS_OF)


@query("variation_24h", f"WITH {BEST}, p AS (SELECT product_id, arg_max(price, seq) AS reference_price FROM r WHERE coalesce(price, 0) <> 0 AND ts <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY product_id) SELECT product_id, current_price, reference_price, (current_price - reference_price) / reference_price * 100 AS percent FROM b JOIN p USING (product_id)")
def variation_24h(spark, sf_dir):
    r = readings(spark, sf_dir)
    return M.variation_24h(r, M.best_offer(H.current_offers(r)), AS_OF)


SUMMARY = f"""{BEST}, pr AS (SELECT * FROM r WHERE coalesce(price, 0) <> 0),
    lo AS (SELECT product_id, min(price) AS lowest_price, arg_min(ts, struct_pack(p := price, s := seq)) AS lowest_at, arg_min(store_id, struct_pack(p := price, s := seq)) AS lowest_store, count(*) AS points FROM pr GROUP BY product_id),
    d1 AS (SELECT product_id, arg_max(price, seq) AS price_24h FROM pr WHERE ts <= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY product_id),
    la AS (SELECT pr.product_id, pr.price AS earlier_price FROM pr JOIN b ON pr.product_id = b.product_id AND store_id = best_store QUALIFY row_number() OVER (PARTITION BY pr.product_id ORDER BY seq DESC) = 2),
    gx AS (SELECT pr.product_id, count(*) AS base, count(*) FILTER (pr.price > current_price) AS dearer FROM pr JOIN b USING (product_id) GROUP BY pr.product_id HAVING count(*) >= 3),
    ra AS (SELECT product_id, dearer / base AS share_dearer, CASE WHEN dearer / base >= 0.9 THEN 'great' WHEN dearer / base >= 0.6 THEN 'good' WHEN dearer / base >= 0.3 THEN 'normal' ELSE 'poor' END AS rating FROM gx),
    ps AS (SELECT i.product_id, current_price, best_store, stores, lowest_price, lowest_at, lowest_store, coalesce(points, 0) AS points, price_24h, earlier_price, rating, share_dearer, current_price - lowest_price AS above_lowest,
    (current_price - lowest_price) / lowest_price * 100 AS above_lowest_percent, (current_price - price_24h) / price_24h * 100 AS percent_24h, (current_price - earlier_price) / earlier_price * 100 AS percent_last
    FROM (SELECT DISTINCT product_id FROM r) i LEFT JOIN b USING (product_id) LEFT JOIN lo USING (product_id) LEFT JOIN d1 USING (product_id) LEFT JOIN la USING (product_id) LEFT JOIN ra USING (product_id))"""


@query("product_summary", f"WITH {SUMMARY} SELECT * FROM ps")
def product_summary(spark, sf_dir):
    r = readings(spark, sf_dir)
    return M.product_summary(r, H.current_offers(r), AS_OF, days=None)  # SQL rates by the whole history


@query(
    "global_summary",
    f"""WITH {SUMMARY}, wx AS (SELECT *, last_value(CASE WHEN coalesce(price, 0) <> 0 THEN price END IGNORE NULLS) OVER (PARTITION BY product_id, store_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_price FROM r)
    SELECT count(*) AS products, count(*) FILTER (coalesce(current_price - price_24h, current_price - earlier_price) < 0) AS falling, count(*) FILTER (above_lowest = 0 AND points > 1) AS new_lows,
    (SELECT count(*) FROM r WHERE CAST(ts AS DATE) = CAST(TIMESTAMP '{AS_OF}' AS DATE)) AS readings_today, (SELECT count(DISTINCT store_id) FROM r) AS stores, (SELECT count(DISTINCT store_id) FROM r WHERE store_id <> 'error') AS stores_active, (SELECT count(DISTINCT p_brand) FROM part) AS queries, (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')) AS queries_active,
    (SELECT count(*) FROM wx WHERE coalesce(price, 0) <> 0 AND coalesce(previous_price, 0) <> 0 AND price < previous_price AND (previous_price - price) / previous_price * 100 >= 5) AS open_opportunities FROM ps""",
)
def global_summary(spark, sf_dir):
    r = readings(spark, sf_dir)
    asked = table(spark, sf_dir, "part").select("p_brand", (~F.col("p_brand").isin("Brand#1", "Brand#2")).alias("active")).distinct()
    stores = r.select("store_id", (F.col("store_id") != "error").alias("active")).distinct()
    return M.global_summary(M.product_summary(r, H.current_offers(r), AS_OF), r, O.price_drops(H.with_running(r)), AS_OF, asked, stores)


@query("price_sanity_band", "WITH p AS (SELECT l_partkey AS product_id, l_extendedprice AS price FROM lineitem), s AS (SELECT product_id, count(*) AS n, list_sort(list(price))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM p WHERE coalesce(price, 0) <> 0 GROUP BY product_id HAVING count(*) >= 3) SELECT p.product_id, median, count(*) FILTER (NOT (price < median * 0.35::DOUBLE OR price > median * 2.6::DOUBLE)) AS kept, count(*) FILTER (price < median * 0.35::DOUBLE OR price > median * 2.6::DOUBLE) AS dropped FROM p JOIN s USING (product_id) WHERE coalesce(price, 0) <> 0 GROUP BY ALL")
def price_sanity_band(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("price"))
    return S.sane_prices(p, "product_id")


@query("vanished_offers", f"WITH {READINGS}, k AS (SELECT DISTINCT product_id, store_id FROM r WHERE ts < TIMESTAMP '2024-01-30'), s AS (SELECT DISTINCT product_id, store_id FROM r WHERE ts >= TIMESTAMP '2024-01-30') SELECT product_id, store_id FROM k WHERE store_id IN (SELECT store_id FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.product_id = k.product_id AND s.store_id = k.store_id)")
def vanished_offers(spark, sf_dir):
    r = readings(spark, sf_dir)
    cut = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return H.vanished(r.filter(F.col("ts") < cut).select("product_id", "store_id").distinct(), r.filter(F.col("ts") >= cut)).select("product_id", "store_id")


@query("absence_streaks", f"WITH {READINGS}, s AS (SELECT DISTINCT product_id, store_id, CAST(day(ts) AS INTEGER) AS round_no FROM r), f AS (SELECT product_id, store_id, min(round_no) AS first_round FROM s GROUP BY ALL), g AS (SELECT product_id, store_id, q.round_no FROM f JOIN (SELECT DISTINCT round_no FROM s) q ON q.round_no >= first_round), m AS (SELECT g.*, s.round_no AS hit FROM g LEFT JOIN s USING (product_id, store_id, round_no)) SELECT product_id, store_id, round_no, round_no - max(hit) OVER (PARTITION BY product_id, store_id ORDER BY round_no) AS absent FROM m")
def absence_streaks(spark, sf_dir):
    seen = readings(spark, sf_dir).select("product_id", "store_id", F.dayofmonth("ts").alias("round_no")).distinct()
    return H.absence_streaks(seen, seen.select("round_no").distinct())


@query("opportunities_feed", f"WITH {RUNNING}, u AS (SELECT 'price_drop' AS kind, product_id, store_id, seq, ts, price, previous_price AS reference_price, -((previous_price - price) / previous_price * 100) AS percent FROM w WHERE coalesce(price, 0) <> 0 AND coalesce(previous_price, 0) <> 0 AND price < previous_price AND (previous_price - price) / previous_price * 100 >= 5 UNION ALL SELECT 'all_time_low', product_id, store_id, seq, ts, price, minimum_before, -((minimum_before - price) / minimum_before * 100) FROM w WHERE coalesce(price, 0) <> 0 AND price < minimum_before) SELECT * FROM u ORDER BY ts DESC, seq DESC, kind LIMIT 200")
def opportunities_feed(spark, sf_dir):
    return O.latest_opportunities(O.opportunities(readings(spark, sf_dir)))


@query("average_offer_price", f"WITH {CURRENT} SELECT product_id, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS BIGINT) / count(*) / 100 AS average_price, count(*) AS offers FROM o WHERE coalesce(price, 0) <> 0 GROUP BY product_id")
def average_offer_price(spark, sf_dir):
    return M.average_price(H.current_offers(readings(spark, sf_dir)))


@query("comparison_bars", f"WITH {CURRENT}, l AS (SELECT *, min(price) OVER (PARTITION BY product_id) AS low FROM o WHERE price > 0) SELECT product_id, store_id, price, greatest(100 * low / price, 4.0::DOUBLE) AS width FROM l")
def comparison_bars(spark, sf_dir):
    return M.comparison_bars(H.current_offers(readings(spark, sf_dir))).select("product_id", "store_id", "price", "width")


@query("price_position", f"WITH {BEST}, h AS (SELECT product_id, min(price) AS lowest_price, max(price) AS highest_price FROM r WHERE coalesce(price, 0) <> 0 GROUP BY product_id) SELECT product_id, current_price, lowest_price, highest_price, CASE WHEN highest_price > lowest_price THEN least(greatest((current_price - lowest_price) / (highest_price - lowest_price) * 100, 0.0::DOUBLE), 100.0::DOUBLE) END AS position FROM b JOIN h USING (product_id)")
def price_position(spark, sf_dir):
    r = readings(spark, sf_dir)
    band = r.filter(H.has_price()).groupBy("product_id").agg(F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"))
    return M.price_position(M.best_offer(H.current_offers(r)).select("product_id", "current_price").join(band, "product_id"))


# --- selection


@query("scope_pairs", "WITH s AS (SELECT s_suppkey, list_filter(string_split(lower(r_name), ' '), lambda t: length(t) > 2) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), q AS (SELECT c_custkey, list_filter(string_split(lower(n_name || ' ' || r_name), ' '), lambda t: length(t) > 2) AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey AS query_id, s_suppkey AS store_id FROM q, s WHERE len(w) = 0 OR len(list_filter(w, lambda a: len(list_filter(t, lambda b: a = b OR contains(a, b) OR contains(b, a))) > 0)) > 0")
def scope_pairs(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    stores = table(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("store_id"), F.split(F.lower("r_name"), " ").alias("scope_words"))
    asked = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.split(F.lower(F.concat_ws(" ", "n_name", "r_name")), " ").alias("tokens"))
    return scope.store_serves(asked, stores).select("query_id", "store_id")


@query("admission_cap", "WITH e AS (SELECT o_custkey AS query_id, count(*) AS have FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_custkey AS query_id, o_orderkey AS ordinal, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F') SELECT c.query_id, ordinal, score, CAST(place AS INTEGER) AS place FROM c LEFT JOIN e USING (query_id) WHERE place <= 10 - coalesce(have, 0)")
def admission_cap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return S.admit(o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'F'"), 10)


@query("coupon_check_quota", f"WITH {CURRENT}, g AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY price, seq) AS k FROM o WHERE coalesce(price, 0) <> 0) SELECT product_id, store_id, seq, price FROM g WHERE k <= 3 ORDER BY price, seq LIMIT 8")
def coupon_check_quota(spark, sf_dir):
    o = H.current_offers(readings(spark, sf_dir)).filter(H.has_price())
    return S.quota(o, [F.col("price"), F.col("seq")], 3, 8).select("product_id", "store_id", "seq", "price")


@query("most_complete_item", "WITH i AS (SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN l_shipdate END AS a, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS b FROM lineitem), f AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n FROM i) SELECT l_partkey, l_orderkey, l_linenumber FROM f QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_orderkey * 100 + l_linenumber) = 1")
def most_complete_item(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, F.col("l_shipdate")).alias("a"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("b"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"))
    return S.keep_most_complete(i, ["l_partkey"], ["a", "b"]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("median_name", "WITH n AS (SELECT p_brand, trim(p_name) AS name, p_partkey FROM part WHERE length(trim(p_name)) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(name), p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS c FROM n) SELECT p_brand, substring(name, 1, 180) AS name FROM r WHERE k = CAST(floor(c / 2) AS BIGINT) + 1")
def median_name(spark, sf_dir):
    return M.median_name(table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal")), "p_brand")


@query("family_position", "SELECT p_brand AS query_id, min(p_partkey) AS position, count(*) AS members, min(p_retailprice) AS from_price FROM part GROUP BY p_brand")
def family_position(spark, sf_dir):
    listed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("position"), F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("current_price"), F.lit(0.0).alias("lowest_price"))
    return V.family_cards(listed).select("query_id", "position", "members", "from_price")


FACET_ITEMS = "i AS (SELECT p_partkey AS ordinal, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part)"


@query(
    "facet_counts",
    f"""WITH {FACET_ITEMS}, t AS (SELECT ordinal, 'brand' AS field, brand AS value, 0 AS place FROM i UNION ALL SELECT ordinal, 'type', type, 1 FROM i UNION ALL SELECT ordinal, 'size', size, 2 FROM i),
    c AS (SELECT field, place, value, count(*) AS count, min(ordinal) AS seen FROM t WHERE value IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, count(*) OVER (PARTITION BY field) AS vals, sum(count) OVER (PARTITION BY field) AS covered FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, seen) AS option_rank FROM w WHERE vals >= 2 AND covered >= 0.15 * (SELECT count(*) FROM i)),
    o AS (SELECT * FROM k WHERE option_rank <= 8),
    u AS (SELECT field, row_number() OVER (ORDER BY 1 - max(count) / max(covered) DESC, max(covered) DESC, any_value(place)) AS facet_rank FROM o GROUP BY field)
    SELECT field, value, count, CAST(option_rank AS INTEGER) AS option_rank, CAST(facet_rank AS INTEGER) AS facet_rank FROM o JOIN u USING (field)""",
)
def facet_counts(spark, sf_dir):
    from precioscope.functions.facets import facet_counts as count

    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    return count(i, ["brand", "type", "size"])


@query("facet_filters", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey <= 2) AND p_size IN (1, 5, 10, 20, 30)")
def facet_filters(spark, sf_dir):
    from precioscope.functions.facets import apply_filters

    part = table(spark, sf_dir, "part")
    some = apply_filters(part, {"p_size": [1, 5, 10, 20, 30], "p_type": []})
    return some.join(part.filter("p_partkey <= 2").select("p_brand"), "p_brand", "left_semi").select("p_partkey", "p_brand", "p_size")


# --- text

NORMAL = r'''trim(regexp_replace(regexp_replace(translate(strip_accents(lower(coalesce(text, ''))), '”“„', '"""'), '[^A-Za-z0-9_\s.,+"\x27-]', ' ', 'g'), '\s+', ' ', 'g'))'''
STOP = "['de','da','do','com','para','e','a','o','em','no','na','por','ou','the','novo','nova']"
TOKENS = rf"list_filter(regexp_split_to_array(n, '[\s,]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


@query("normalised_titles", f"WITH x AS (SELECT doc_id, {NORMAL} AS n FROM documents) SELECT doc_id, md5(n) AS normal_md5, CAST(len({TOKENS}) AS INTEGER) AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5, md5(regexp_replace(n, '[\\s.-]+', '', 'g')) AS compact_md5 FROM x")
def normalised_titles(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("n")).withColumn("t", X.tokens_normal(F.col("n")))
    return x.select("doc_id", F.md5("n").alias("normal_md5"), F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.md5(X.compact_normal(F.col("n"))).alias("compact_md5"))


@query(
    "similar_titles",
    f"""WITH x AS (SELECT item_id, text FROM benchmark), y AS (SELECT item_id, {NORMAL} AS n FROM x), t AS (SELECT item_id, list_distinct({TOKENS}) AS t FROM y),
    k AS (SELECT item_id, unnest(t) AS w FROM t), p AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM k a JOIN k b USING (w) WHERE a.item_id < b.item_id),
    s AS (SELECT p.a, p.b, len(list_intersect(x.t, y.t)) AS c, len(x.t) AS n, len(y.t) AS m FROM p JOIN t x ON x.item_id = p.a JOIN t y ON y.item_id = p.b)
    SELECT a, b, 0.45::DOUBLE * (c / (n + m - c)) + 0.55::DOUBLE * (c / least(n, m)) AS similarity FROM s WHERE 0.45::DOUBLE * (c / (n + m - c)) + 0.55::DOUBLE * (c / least(n, m)) > 0.05::DOUBLE""",
)
def similar_titles(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    # Candidate pairs share a token; the score is computed once per pair.
    k = t.select("item_id", F.explode("t").alias("w"))
    pairs = k.alias("x").join(k.alias("y"), "w").filter("x.item_id < y.item_id").select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).distinct()
    both = pairs.join(t.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("item_id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", X.similarity(F.col("ta"), F.col("tb")).alias("similarity")).filter("similarity > 0.05")


@query(
    "spec_extraction",
    r"""WITH t AS (SELECT p_partkey, p_name || ' ' || p_size || 'gb ' || (p_size % 3 + 1) || ',5 litros ' || (100 + p_size) || ' v ddr' || (p_size % 5) AS text FROM part),
    y AS (SELECT p_partkey, """ + NORMAL + r""" AS n FROM t),
    q AS (SELECT p_partkey, n, regexp_extract_all(n, '\b(\d+(?:[.,]\d+)?)\s*(gb|tb|mb|ghz|mhz|bits|bit|w|v|hz|ml|l|kg|g|mm|cm|pol|polegadas|"|k|p)(?:[^a-z0-9]|$)', 1) AS a, regexp_extract_all(n, '\b(\d+(?:[.,]\d+)?)\s*(gb|tb|mb|ghz|mhz|bits|bit|w|v|hz|ml|l|kg|g|mm|cm|pol|polegadas|"|k|p)(?:[^a-z0-9]|$)', 2) AS u, regexp_extract_all(n, '\b(ddr\d|4k|8k|full hd|fhd|uhd|qhd|wifi\s?6e?|usb\s?c|type\s?c|bivolt|110v|127v|220v)\b', 1) AS d FROM y),
    s AS (SELECT p_partkey, list_concat(list_transform(list_zip(a, u), lambda z: replace(z[1], ',', '.') || CASE WHEN z[2] IN ('polegadas', '"') THEN 'pol' ELSE z[2] END), d) AS l FROM q),
    v AS (SELECT p_partkey, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM s),
    w AS (SELECT p_partkey, i, CASE WHEN TRY_CAST(nullif(regexp_extract(e, '^(\d{2,3})v$', 1), '') AS INT) BETWEEN 100 AND 130 THEN '127v' WHEN TRY_CAST(nullif(regexp_extract(e, '^(\d{2,3})v$', 1), '') AS INT) BETWEEN 200 AND 250 THEN '220v' ELSE e END AS e FROM v),
    x AS (SELECT p_partkey, e, min(i) AS i FROM w GROUP BY ALL)
    SELECT p_partkey, string_agg(e, ',' ORDER BY i) AS specs FROM x GROUP BY p_partkey""",
)
def spec_extraction(spark, sf_dir):
    title = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.lit("gb "), F.col("p_size") % 3 + 1, F.lit(",5 litros "), 100 + F.col("p_size"), F.lit(" v ddr"), F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.specs_normal(X.normalise(title)), ",").alias("specs"))


@query("one_edit_names", "WITH n AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS w FROM part), w AS (SELECT DISTINCT w FROM n) SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= 1 AND levenshtein(a.w, b.w) <= 1")
def one_edit_names(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.lower(F.split("p_name", " ")[0]).alias("w")).distinct()
    # Words within one edit share what is left when one letter, or none, is taken out.
    cut = F.concat(F.array("w"), F.transform(F.sequence(F.lit(1), F.greatest(F.length("w"), F.lit(1))), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.lit(1 << 20)))))
    k = w.select("w", F.explode(F.array_distinct(cut)).alias("k"))
    pairs = k.alias("x").join(k.alias("y"), "k").filter("x.w < y.w").select(F.col("x.w").alias("a"), F.col("y.w").alias("b")).distinct()
    return pairs.filter(X.within_one_edit(F.col("a"), F.col("b")))


@query("relevance_share", "WITH x AS (SELECT lang, regexp_replace(" + NORMAL + r", '[\s.-]+', '', 'g') AS c FROM documents) SELECT lang, count(*) AS items, count(*) FILTER (contains(c, 'erbleen') OR contains(c, 'thonation')) AS related, count(*) FILTER (contains(c, 'erbleen') OR contains(c, 'thonation')) / count(*) AS relevance FROM x GROUP BY lang")
def relevance_share(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in QUERY_WORDS if len(w) > 3])
    return W.relevance(table(spark, sf_dir, "documents"), ["lang"], words, F.col("text"))


# Titles and queries below are put together from part columns, so that SQL can tell what must come out.

INTERPRETED = "p AS (SELECT p_partkey, p_size, list_filter(string_split(p_name, ' '), lambda w: length(w) > 2) AS w FROM part)"


@query("query_interpretation", f"WITH {INTERPRETED} SELECT p_partkey, true AS accepted, CASE WHEN p_size % 3 = 0 THEN 'product' ELSE 'product+brand' END AS kind, 'dell' AS brand, 'notebook' AS category, CASE WHEN p_size % 3 = 0 THEN 'zk' || (100 + p_size) ELSE '' END AS models, CASE WHEN p_size % 2 = 0 THEN p_size || 'gb' ELSE '' END AS specs, array_to_string(w, ' ') AS keywords, least(100, 40 + CASE WHEN p_size % 3 = 0 THEN 22 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 8 ELSE 0 END + 2 * least(6, 2 + len(w) + (p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT) + 14 * least(2, len(w))) AS specificity FROM p")
def query_interpretation(spark, sf_dir):
    from precioscope.operators.interpret import interpret

    n = F.col("p_size")
    text = F.concat_ws(" ", F.lit("Notebook  DELL"), "p_name", F.when(n % 3 == 0, F.concat(F.lit("ZK"), (100 + n).cast("string"))), F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit("GB"))))
    q = interpret(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")))
    joined = lambda c: F.array_join(c, " ").alias(c)
    return q.select("p_partkey", "accepted", "kind", "brand", "category", joined("models"), joined("specs"), joined("keywords"), "specificity")


@query("listing_scores", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 86 WHEN 4 THEN 59 ELSE 0 END AS score, 62 AS threshold, p_size % 5 = 0 AS accepted, p_size % 5 = 4 AS ambiguous, p_size % 5 NOT IN (0, 4) AS eliminated, CASE p_size % 5 WHEN 1 THEN 'used: usado' WHEN 2 THEN 'accessory: capa' WHEN 3 THEN 'word missing' END AS reason FROM part")
def listing_scores(spark, sf_dir):
    from precioscope.operators.interpret import interpret

    asked = interpret(spark.createDataFrame([("q", "notebook dell zorkian")], "query_id string, text string"))
    names = F.array(*map(F.lit, ("Notebook Dell Zorkian prata", "Notebook Dell Zorkian usado", "Capa de couro zorkian", "Notebook Dell outro", "Dell Zorkian prata")))
    part = table(spark, sf_dir, "part").select(F.lit("q").alias("query_id"), "p_partkey", F.get(names, F.col("p_size") % 5).alias("name"))
    return S.score(part.join(asked, "query_id")).select("p_partkey", "score", "threshold", "accepted", "ambiguous", "eliminated", "reason")


@query("price_sanity", "WITH p AS (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price, CAST(l_partkey % 3 * 30 AS INTEGER) AS spec FROM lineitem), g AS (SELECT l_suppkey, spec, count(*) AS n, count(price) AS priced, list_sort(list(price) FILTER (price IS NOT NULL)) AS l FROM p GROUP BY ALL), m AS (SELECT *, l[CAST(floor(len(l) / 2) AS BIGINT) + 1] AS median FROM g), b AS (SELECT *, median * CASE WHEN priced < 5 THEN 0.3::DOUBLE WHEN spec < 55 THEN 0.22::DOUBLE ELSE 0.35::DOUBLE END AS low, median * CASE WHEN priced < 5 THEN 3.6::DOUBLE WHEN spec < 55 THEN 3.4::DOUBLE ELSE 2.6::DOUBLE END AS high, spec >= 30 AND n >= CASE WHEN spec >= 55 THEN 3 ELSE 6 END AND priced >= CASE WHEN spec >= 55 THEN 3 ELSE 6 END AS judged FROM m) SELECT id, NOT coalesce(judged AND (price < low OR price > high), false) AS kept FROM p JOIN b USING (l_suppkey, spec)")
def price_sanity(spark, sf_dir):
    none = F.array().cast("array<string>")
    i = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("price"), (F.col("l_partkey") % 3 * 30).cast("int").alias("specificity"), none.alias("keywords"))
    return S.price_sanity(i.withColumn("spec", F.col("specificity")), "l_suppkey", "spec").select("id", "kept")


@query("title_attributes", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'corei5' WHEN 1 THEN 'ryzen7' ELSE 'm2' END AS processor, CASE WHEN p_size % 3 = 2 THEN 'm2pro' END AS generation, 4 * (1 + p_size % 4) || 'gb' AS memory, 128 * (1 + p_size % 4) || 'gb' AS storage, 10 + p_size % 8 || 'pol' AS screen, CASE WHEN p_size % 2 = 0 THEN '127v' ELSE 'bivolt' END AS voltage, CASE p_size % 2 WHEN 0 THEN 'preto' ELSE 'azul' END AS colour, CASE WHEN p_size % 4 = 0 THEN 'a' || 2000 + p_size END AS model, CASE WHEN p_size % 5 = 0 THEN '1.5l' END AS capacity FROM part")
def title_attributes(spark, sf_dir):
    from precioscope.functions.facets import attributes

    n = F.col("p_size")
    text = lambda c: c.cast("string")
    title = F.concat_ws(
        " ",
        F.when(n % 3 == 0, "Notebook Core i5").when(n % 3 == 1, "Notebook Ryzen 7").otherwise("MacBook M2 Pro"),
        F.when(n % 2 == 0, "branco").otherwise("verde"),
        F.concat(text(4 * (1 + n % 4)), F.lit(" GB de RAM")),
        F.concat(text(128 * (1 + n % 4)), F.lit("GB SSD")),
        F.concat(text(10 + n % 8), F.lit(" polegadas")),
        F.when(n % 2 == 0, "110 V").otherwise("bivolt"),
        F.when(n % 4 == 0, F.concat(F.lit("A"), text(2000 + n))),
        F.when(n % 5 == 0, "1,5 litros"),
        F.when(n % 2 == 0, "preto").otherwise("azul"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", attributes(title).alias("a")).select("p_partkey", "a.*")


@query("facet_labels", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'M4 Pro' WHEN 1 THEN p_size || ' GB' WHEN 2 THEN p_size || ' polegadas' WHEN 3 THEN '127V' ELSE '1.5 L' END AS label, 'M4 ou M4 Pro · 16 GB' AS filters FROM part")
def facet_labels(spark, sf_dir):
    from precioscope.functions.facets import describe_filters, label

    n = F.col("p_size")
    field = F.get(F.array(*map(F.lit, ("processor", "memory", "screen", "voltage", "capacity"))), n % 5)
    value = F.get(F.array(F.lit("m4pro"), F.concat(n.cast("string"), F.lit("gb")), F.concat(n.cast("string"), F.lit("pol")), F.lit("127v"), F.lit("1.5l")), n % 5)
    told = describe_filters({"memory": ["16gb"], "processor": ["m4", "m4pro"], "colour": []})
    return table(spark, sf_dir, "part").select("p_partkey", label(field, value).alias("label"), told.alias("filters"))
