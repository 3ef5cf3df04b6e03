"""A database table read by ranges of its key, one task a range, and appends that may be repeated.

The source is named ``watch_paged``.  It goes through any DB-API module that the executors have, so a table behind a
driver of its own is read without a JVM driver; filters on columns become its WHERE clause, and only
the columns of the schema are asked for.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, StructType

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
FETCH = 1000


class KeyRange(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options, self.where = schema, options, []
        self.key = options["key"]

    def connect(self):
        return importlib.import_module(self.options.get("module", "sqlite3")).connect(self.options["database"])

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes comparisons of columns with values that every database orders as Spark does; gives the rest back."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == v
            if column and isinstance(f, IsNotNull):
                self.where.append((f"{_quoted(column)} IS NOT NULL", ()))
            elif column and type(f) in COMPARED and (plain(f.value) or isinstance(f, EqualTo) and isinstance(f.value, str)):
                self.where.append((f"{_quoted(column)} {COMPARED[type(f)]} ?", (f.value,)))
            elif column and isinstance(f, In) and all(plain(v) for v in f.value):
                self.where.append((f"{_quoted(column)} IN ({', '.join('?' * len(f.value))})", tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        """The given bounds (``bounds``: JSON list of [first, last]), else equal ranges of the key."""
        if self.options.get("bounds"):
            return [KeyRange(a, b) for a, b in json.loads(self.options["bounds"])]
        connection = self.connect()
        try:
            low, high = connection.cursor().execute(f"SELECT min({_quoted(self.key)}), max({_quoted(self.key)}) FROM {_quoted(self.options['table'])}").fetchone()
        finally:
            connection.close()
        # Rows without a key belong to no range.
        if low is None:
            return [KeyRange(None, None)]
        n = max(1, min(int(self.options.get("ranges", "8")), high - low + 1))
        edges = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [KeyRange(a, b - 1) for a, b in zip(edges, edges[1:])] + [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        key = _quoted(self.key)
        here = (f"{key} IS NULL", ()) if partition.first is None else (f"{key} BETWEEN ? AND ?", (partition.first, partition.last))
        clauses = [here, *self.where]
        flags = [isinstance(f.dataType, BooleanType) for f in self.schema.fields]
        sql = f"SELECT {', '.join(_quoted(f.name) for f in self.schema.fields)} FROM {_quoted(self.options['table'])} WHERE {' AND '.join(c for c, _ in clauses)}"
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql, tuple(v for _, values in clauses for v in values))
            while rows := cursor.fetchmany(FETCH):
                for row in rows:
                    yield tuple(bool(v) if flag and v is not None else v for v, flag in zip(row, flags))
        finally:
            connection.close()


class PagedSource(DataSource):
    """Options: module (a DB-API module; sqlite3), database, table, key (a whole-number column), ranges or bounds.
    The schema must be given; it names the columns to read."""

    @classmethod
    def name(cls) -> str:
        return "watch_paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def read_paged(spark: SparkSession, schema: str, **options: str) -> DataFrame:
    """The rows of a database table; ``options`` as in ``PagedSource``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("watch_paged").schema(schema).options(**options).load()


def bounds_of(pages: DataFrame, per_task: int = 1000) -> str:
    """The option ``bounds`` from the pages of ``crawl.paged``, ``per_task`` pages to a task."""
    tasks = pages.groupBy(F.floor(F.col("page") / per_task).alias("task")).agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("task")
    return json.dumps([[r["first"], r["last"]] for r in tasks.collect()])  # two numbers a task


def append_once(points: DataFrame, path: str, batch: int) -> None:
    """Appends ``points`` as batch number ``batch``, by month of ts: a batch written again replaces itself, so a
    repeat after a failure adds nothing twice.  Rows without a time are kept in a month of their own."""
    month = F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("none"))
    points.withColumn("month", month).repartition("month", "product_id").sortWithinPartitions("month", "product_id", "ts").write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch={batch}")
