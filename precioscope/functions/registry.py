"""The rules as functions of SQL, for a session that asks in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from precioscope.functions.identity import identify, same_product
from precioscope.functions.tables import register_tables

#: Name, parameters, type and body of the functions that SQL itself can express.
SQL_FUNCTIONS = (
    ("watch_with_coupon", "price DOUBLE, kind STRING, value DOUBLE", "DOUBLE", "round(greatest(CASE kind WHEN 'percent' THEN price * (1 - value / 100) WHEN 'amount' THEN price - value ELSE price END, 0), 2)"),
    ("watch_offer_cost", "discounted DOUBLE, price DOUBLE", "DOUBLE", "coalesce(nullif(discounted, 0), price)"),
    ("watch_bar_width", "least_price DOUBLE, price DOUBLE", "DOUBLE", "greatest(100 * least_price / price, 4)"),
    ("watch_position", "price DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "CASE WHEN high > low THEN least(greatest((price - low) / (high - low) * 100, 0), 100) END"),
    ("watch_rating", "share DOUBLE", "STRING", "CASE WHEN share >= 0.9 THEN 'great' WHEN share >= 0.6 THEN 'good' WHEN share >= 0.3 THEN 'normal' ELSE 'poor' END"),
)


def register(spark: SparkSession) -> list[str]:
    """Registers the functions in the session and returns their names.  What needs the identity rules goes
    in Arrow batches: watch_identity_key(title) and watch_same_product(title, title).  Table functions are in ``functions.tables``."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.pandas_udf("string")
    def identity_key(title: pd.Series) -> pd.Series:
        return title.map(lambda t: identify(t).key)

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_product(identify(x), identify(y))[0] for x, y in zip(a, b, strict=True)])

    spark.udf.register("watch_identity_key", identity_key)
    spark.udf.register("watch_same_product", same)
    return [*(f[0] for f in SQL_FUNCTIONS), "watch_identity_key", "watch_same_product", *register_tables(spark)]
