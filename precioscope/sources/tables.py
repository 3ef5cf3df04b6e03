"""Schemas, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READING = "product_id string, store_id string, seq long, ts timestamp, price decimal(12,2), list_price decimal(12,2), available boolean, url string"
OFFER = "product_id string, store_id string, url string, title string, price double, list_price double, other_price double, available boolean, score int, absent_rounds int, manual boolean, condition string, instalments struct<times:int,amount:double,no_interest:boolean,total:double>, coupon struct<kind:string,value:double>, cash_percent double, updated_at timestamp"
OPPORTUNITY = "kind string, product_id string, store_id string, seq long, ts timestamp, price double, reference_price double, percent double, is_read boolean"
PAGE = "page_id long, url string, status int, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; the html column is read only by plans that use it."""
    return spark.read.parquet(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines table; lines that do not parse are kept in _corrupt_record, never dropped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_state(df: DataFrame, path: str, replace: bool = False) -> None:
    """Refuses an existing table unless told to replace it."""
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def import_state(collections: dict[str, DataFrame], path: str, replace: bool = False) -> None:
    """Writes every collection as a table under ``path``; refuses, before writing any, if one of them
    exists with rows and ``replace`` is not set.  Tables of ``path`` that are not given stay."""
    spark = next(iter(collections.values())).sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda name: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    if not replace:
        full = [n for n, df in collections.items() if there(n) and spark.read.schema(df.schema).json(f"{path}/{n}").limit(1).count()]
        if full:
            raise ValueError(f"not empty, and not to be replaced: {', '.join(sorted(full))}")
    for name, df in collections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def append_history(points: DataFrame, path: str) -> None:
    """Change points by month, sorted by product and time inside files, as look-ups read them."""
    points.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("month", "product_id").sortWithinPartitions("product_id", "ts").write.mode("append").partitionBy("month").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key of both tables, by a map-side maximum."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def distinct_scans(requests: DataFrame) -> DataFrame:
    """One scan of each store, term and page count, whoever asks."""
    return requests.dropDuplicates(["store_id", "term", "pages"])


def export_rows(history: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """History as export columns; what a product or store id no longer names is shown as the id."""
    out = history.join(products, "product_id", "left").join(stores, "store_id", "left")
    price = F.replace(F.format_string("%.2f", F.col("price").cast("double")), F.lit("."), F.lit(","))
    return out.select(F.coalesce("product_name", F.col("product_id").cast("string")).alias("produto"), F.coalesce("brand", F.lit("")).alias("marca"), F.coalesce("store_name", F.col("store_id").cast("string")).alias("loja"), F.coalesce(F.when(F.col("price").isNotNull(), price), F.lit("")).alias("preco"), F.when(F.coalesce("available", F.lit(True)), "sim").otherwise("nao").alias("disponivel"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("data"), F.coalesce("url", F.lit("")).alias("url"))


def write_export(rows: DataFrame, path: str) -> None:
    """Semicolons, every field quoted, CRLF lines, a byte-order mark at each file's head."""
    first, *rest = rows.columns
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").options(sep=";", quoteAll="true", header="true", lineSep="\r\n", emptyValue="").csv(path) if rest else rows.write.csv(path)


def sitemap_candidates(urls: DataFrame, terms: DataFrame, most: int = 8) -> DataFrame:
    """The best ``most`` addresses per store and term, without touching page bodies."""
    from precioscope.functions.policy import url_score

    scored = urls.join(terms, "store_id").withColumn("score", url_score(F.col("url"), F.col("terms"))).filter("score > 0")
    order = Window.partitionBy("store_id", "term_id").orderBy(F.col("score").desc(), "url")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
