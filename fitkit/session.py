"""Session-level helpers: the shared scratch folder and Arrow batch sizes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting it on the context if needed.

    The folder named by ``spark.checkpoint.dir`` is used as it is.  Only a local
    master, where driver and executors share one disk, may fall back to a fresh
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="fitkit-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder for a table of this run."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class TableChain:
    """Successive versions of a small keyed table, each written to the shared folder.

    A written table cuts the lineage and survives lost executors; the version before
    the last is deleted, as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.paths: list[str] = []
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            drop_path(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        drop_path(self.spark, self.root)
        self.paths.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run, wherever Spark's file systems reach it."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, bytes_per_row: int, budget: int = 64 << 20):
    """Limit Arrow batches by bytes while the jobs inside the block are planned.

    ``maxRecordsPerBatch`` counts rows; a packed block or a 10,000-wide feature
    array makes its default of 10,000 rows far too large.  ``maxBytesPerBatch`` ends a
    batch after the row that reaches it, whatever the rows turn out to weigh.
    """
    limits = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": max(1, min(10_000, budget // max(1, bytes_per_row))),
        "spark.sql.execution.arrow.maxBytesPerBatch": max(1, budget),
    }
    old = {key: spark.conf.get(key) for key in limits}
    for key, limit in limits.items():
        spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
