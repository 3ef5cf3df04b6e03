"""Queries of sliding minima, timed back-off, the table of all streamed readings and table functions, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from precioscope.operators import sliding
from precioscope.queries import ORACLES, READINGS, query, readings, table
from precioscope.queries_web import _shop_pages, _stream
from precioscope.sources.staging import staging_root


def _folder(spark, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("sliding_lows", f"WITH {READINGS} SELECT product_id, seq, price, min(price) OVER (PARTITION BY product_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS low FROM r WHERE coalesce(price, 0) <> 0")
def sliding_lows(spark, sf_dir):
    """The rows of rolling_lows, with a product's history dealt over blocks of time."""
    return sliding.sliding_low(readings(spark, sf_dir), 7).select("product_id", "seq", "price", "low")


@query(
    "streamed_sliding_lows",
    """WITH d AS (SELECT user_id AS product_id, CAST(ts AS DATE) AS day, min(value) AS low FROM events WHERE coalesce(value, 0) <> 0 GROUP BY ALL), e AS (SELECT max(ts) - INTERVAL 1 DAY AS edge FROM events WHERE coalesce(value, 0) <> 0),
    w AS (SELECT product_id, day - CAST(k AS INTEGER) AS first_day, low FROM d, range(7) t(k), e WHERE day + INTERVAL 1 DAY <= edge)
    SELECT product_id, CAST(first_day AS VARCHAR) AS first_day, CAST(first_day + 6 AS VARCHAR) AS last_day, min(low) AS low FROM w, e WHERE first_day + INTERVAL 7 DAY <= edge GROUP BY product_id, first_day""",
)
def streamed_sliding_lows(spark, sf_dir):
    from precioscope.streaming.notices import drained

    out = drained(sliding.sliding_stream(_stream(spark, sf_dir), 7), "sliding")
    return out.select("product_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "low")


@query("streamed_backoff", ORACLES["host_backoff"])
def streamed_backoff(spark, sf_dir):
    """The waits of host_backoff from a stream whose state is timed."""
    from precioscope.streaming.notices import drained
    from precioscope.streaming.pacing import live_backoff

    retry = F.when(F.col("seq") % 10 == 0, 30.0).when(F.col("seq") % 35 == 1, 600.0)
    host = F.concat("store_id", (F.col("product_id") % 40).cast("string"))
    responses = _stream(spark, sf_dir).select(host.alias("host"), F.col("seq").alias("ordinal"), F.when(F.col("seq") % 5 < 2, 429).otherwise(200).alias("status"), retry.alias("retry_after"), (F.col("seq") * 20_000 + 1_700_000_000_000).alias("at_ms"))
    return drained(live_backoff(responses), "backoff")


@query("bronze_readings", "SELECT event_id AS seq, user_id AS product_id, event_type AS store_id, value AS price, false AS late FROM events")
def bronze_readings(spark, sf_dir):
    """Every streamed reading in the table; one delivery of all readings has none that is late."""
    from precioscope.streaming.bronze import bronze_at, write_bronze

    path, stream = _folder(spark, "bronze"), _stream(spark, sf_dir)
    write_bronze(stream, path).start().awaitTermination()
    return bronze_at(spark, path, stream.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).select("seq", "product_id", "store_id", "price", "late")


@query("lateral_listings", ORACLES["page_listings"])
def lateral_listings(spark, sf_dir):
    """The listings of page_listings, asked for in SQL by a table function."""
    from precioscope.functions.extract import spread
    from precioscope.functions.tables import register_tables
    from precioscope.operators.listings import chosen_listings

    register_tables(spark)
    name = F.concat(F.lit("Produto "), F.col("p_name"), F.lit(" n"), F.col("p_partkey").cast("string"))
    pages = spread(_shop_pages(spark, sf_dir, name))
    found = spark.sql("SELECT p.page_id, l.* FROM {pages} p, LATERAL watch_listings(p.html, p.url) l", pages=pages)
    return chosen_listings(found).select("page_id", "strategy", "name", "price", "url")
