"""Table functions of SQL: what a page holds, as rows beside the page."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from precioscope.functions.dom import parse
from precioscope.functions.extract import FIELDS, LISTING_SCHEMA, find_coupons, read_strategies

LISTING_ROW = LISTING_SCHEMA.split(", ", 1)[1]  # without the page's id
COUPON_ROW = "kind string, value double, text string, applied boolean, condition string"


class Listings:
    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for strategy, i, item in read_strategies(html, url):
            if i is not None:
                yield (strategy, i, *(item.get(f) for f in FIELDS))


class Failures:
    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for strategy, i, reason in read_strategies(html, url):
            if i is None:
                yield strategy, reason


class Coupons:
    def eval(self, html: str) -> Iterator[tuple]:
        for c in find_coupons(parse(html)):
            yield c["kind"], c["value"], c["text"], c["applied"], c["condition"]


#: Name, class and rows of the table functions.
TABLE_FUNCTIONS = (
    ("watch_listings", Listings, LISTING_ROW),
    ("watch_listing_failures", Failures, "strategy string, error string"),
    ("watch_coupons", Coupons, COUPON_ROW),
)


def register_tables(spark: SparkSession) -> list[str]:
    """Registers the table functions, to be used as ``SELECT ... FROM pages, LATERAL watch_listings(html, url)``."""
    for name, cls, rows in TABLE_FUNCTIONS:
        spark.udtf.register(name, udtf(cls, returnType=rows, useArrow=True))  # a page's rows at a time, not those of 100 pages
    return [f[0] for f in TABLE_FUNCTIONS]
