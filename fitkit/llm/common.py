"""Helpers shared by the corpus operators: tables in the shared folder, Arrow kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.session import scratch_path

#: Word separators of the corpus operators: space and \t \n \v \f \r.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run in the shared checkpoint folder, which may be dropped early.

    A written table cuts the lineage and survives lost executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.count = 0

    def write(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names (in any case) renamed, and what gives them back.

    The second is a function that selects the columns of ``docs``, under their own names, from a table
    to which an operator has added its own columns of these names.
    """
    own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    renamed = docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns])

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])

    return renamed, back


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4 (null id: of the empty text)."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None))
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def texts(batch: pa.RecordBatch, column: int | str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_rows(
    df: DataFrame,
    body: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: T.StructType,
    piece: int = 8 << 20,
) -> DataFrame:
    """Apply an Arrow kernel batch by batch.

    ``body`` runs once per task and returns the function of one batch, which gives
    the output columns by name.  Long texts are cut off into batches of their own
    size, so that a kernel never holds more than about ``piece`` bytes of text at once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = body()
        for batch in batches:
            step = max(1, int(len(batch) * min(1.0, piece / max(1, batch.nbytes))))
            for at in range(0, len(batch), step):
                got = kernel(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], type=f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)
