"""All readings of a stream in one table, late ones marked; what is on time goes on to the alerts.

A micro-batch is one folder, replaced if the batch is tried again, and beside it stands the greatest time of all
batches so far.  From that the next batch knows its watermark, so the mark does not depend on who asks or when.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precioscope.streaming.alerts import live_events


def write_bronze(readings: DataFrame, path: str, lateness: str = "1 day"):
    """Writer of a stream of ``readings`` into ``path``/rows/batch=N/late=..., to be started.

    A row is late if its time is more than ``lateness`` before the greatest time of the batches before its own;
    rows without a time are not late.  No row is dropped.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _latest(spark, path, number)
        if before is not None:
            edge = F.expr(f"timestamp_micros({before}L) - interval {lateness}")
            late = F.coalesce(F.col("ts").cast("timestamp") < edge, F.lit(False))
        else:
            late = F.lit(False)
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={number}")
        # Read back, so that the source is read once and the mark tells what was written.
        written = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={number}")
        latest = written.agg(F.greatest(F.max(F.unix_micros(F.col("ts").cast("timestamp"))), F.lit(before).cast("long")).alias("latest"))
        latest.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    _start(readings, path)
    return readings.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)


def _start(readings: DataFrame, path: str) -> None:
    """The tables exist from the beginning, empty."""
    spark = readings.sparkSession
    spark.createDataFrame([], "latest long").write.mode("overwrite").parquet(f"{path}/marks/batch=-1")


def _latest(spark: SparkSession, path: str, number: int) -> int | None:
    marks = spark.read.schema("latest long, batch long").parquet(f"{path}/marks")
    return marks.filter(F.col("batch") < number).agg(F.max("latest")).first()[0]


def bronze_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows, with batch and late."""
    return spark.read.schema(f"{schema}, batch long, late boolean").option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def alerts_of(spark: SparkSession, path: str, schema: str, lateness: str = "1 day") -> DataFrame:
    """Change points and opportunities of the rows on time, as a stream over the table; to be started when
    the batches in it are whole."""
    rows = spark.readStream.schema(f"{schema}, batch long, late boolean").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return live_events(rows.filter("not late").drop("batch", "late"), lateness)
