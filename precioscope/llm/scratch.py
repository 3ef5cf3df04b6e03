"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it again, so a lost
executor costs at most the stage that was running.  Where the session names no such folder, one
temporary folder per process is used in local mode; on a cluster that is an error, since executors
would each write to a disk of their own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session while it writes a table: shuffle files go with it, Arrow batches are bounded in bytes.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_OWN: list[str] = []
_OPEN: list = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or this process's own where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="precioscope-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


class Scratch:
    """Tables of one operator run; ``drop`` frees those that nothing reads any more.

    Tables that the operator's lazy result reads stay in the shared folder; who has written that result
    frees them by drop_since.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _OPEN.append(self)

    def new_path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str, dictionary: bool = False) -> DataFrame:
        """Write ``df`` and read it back; the path is kept as ``scratch_path`` on the result."""
        path = self.new_path(name)
        # What was shuffled for the table is not needed once it is written; by default Spark keeps it
        # until the driver happens to collect its garbage, which may be long after the disks are full.
        before = {k: self.spark.conf.get(k, None) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and getattr(df, "scratch_path", None):
                self._delete(df.scratch_path)

    def drop_all(self) -> None:
        self._delete(self.root)

    @staticmethod
    def opened() -> int:
        """A mark of now for drop_since."""
        return len(_OPEN)

    @staticmethod
    def drop_since(mark: int) -> None:
        """Drop all tables of the runs begun since the mark, once what they gave is written elsewhere."""
        for other in _OPEN[mark:]:
            other.drop_all()
        del _OPEN[mark:]

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
