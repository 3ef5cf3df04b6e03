"""Extraction that keeps what fails: listings, a quarantine of failures and the run's counters from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from precioscope.functions.extract import LISTING_SCHEMA, read_listings
from precioscope.operators.history import has_price

SCHEMA = f"{LISTING_SCHEMA}, error string, failed boolean"


def store_extraction(pages: DataFrame, path: str, rules: dict | None = None) -> dict[str, int]:
    """Reads ``pages`` once and writes listings and failures apart under ``path``; returns the counters that
    the same pass observed: listings, priced ones and failures."""
    seen = Observation("extraction")
    rows = read_listings(pages, rules).withColumn("failed", F.col("error").isNotNull())
    counted = rows.observe(seen, F.count_if(~F.col("failed")).alias("listings"), F.count_if(~F.col("failed") & has_price()).alias("priced"), F.count_if("failed").alias("failures"))
    counted.write.mode("overwrite").partitionBy("failed").parquet(path)
    return seen.get


def listings_at(spark: SparkSession, path: str) -> DataFrame:
    """The listings stored under ``path``."""
    return spark.read.schema(SCHEMA).parquet(path).filter("not failed").drop("failed", "error")


def quarantine_at(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, strategy, error): what failed."""
    return spark.read.schema(SCHEMA).parquet(path).filter("failed").select("page_id", "strategy", "error")
