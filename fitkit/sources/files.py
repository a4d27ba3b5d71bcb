"""File sources and sinks (any Hadoop-compatible URI)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def relayout(df: DataFrame, num_partitions: int | None, coalesce: bool = True) -> DataFrame:
    """Fewer partitions without a shuffle (``coalesce``) or exactly this many with one."""
    if num_partitions is None or num_partitions <= 0:
        return df
    return df.coalesce(num_partitions) if coalesce else df.repartition(num_partitions)


def read_libsvm(
    spark: SparkSession,
    path: str,
    d: int,
    *,
    num_partitions: int | None = None,
    coalesce: bool = True,
    row_id: bool = False,
) -> DataFrame:
    """Read libsvm files as ``(y DOUBLE, x ARRAY<DOUBLE>)`` with ``d`` features.

    The width is always given by the caller: train and test files would otherwise
    be free to disagree on it, and inferring it costs one more scan.  The format has
    no key; ``row_id`` adds a unique ``id BIGINT`` by file split and position in it,
    taken on the scan itself so that a retried task repeats it.
    """
    raw = spark.read.format("libsvm").option("numFeatures", str(d)).load(path)
    columns = [F.col("label").alias("y"), vector_to_array("features").alias("x")]
    if row_id:
        columns.insert(0, F.monotonically_increasing_id().alias("id"))
    return relayout(raw.select(*columns), num_partitions, coalesce)


def write_libsvm(df: DataFrame, path: str, *, label: str = "y", features: str = "x") -> None:
    """Write ``(label, features)`` as 1-based libsvm text."""
    (
        df.select(
            F.col(label).cast("double").alias("label"),
            array_to_vector(F.col(features)).alias("features"),
        )
        .write.format("libsvm")
        .save(path)
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(value STRING)`` per line."""
    return spark.read.text(path)


def parse_libsvm_text(df: DataFrame, d: int, *, line: str = "value") -> DataFrame:
    """Parse libsvm lines with built-in expressions into ``(y, x ARRAY<DOUBLE>)``.

    Indices in the text are 1-based.  One outside ``1..d`` raises an error when
    the query runs instead of being dropped or shifted.
    """
    tokens = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda t: t != F.lit(""))
    pairs = F.transform(
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda t: F.split(t, ":"),
    )
    parsed = df.select(
        F.element_at(tokens, 1).cast("double").alias("y"),
        F.transform(pairs, lambda p: F.element_at(p, 1).cast("int")).alias("ix"),
        F.transform(pairs, lambda p: F.element_at(p, 2).cast("double")).alias("v"),
    )
    in_range = F.forall(F.col("ix"), lambda i: (i >= 1) & (i <= F.lit(d)))
    checked = F.when(in_range, F.map_from_arrays("ix", "v")).otherwise(
        F.raise_error(F.lit(f"libsvm index outside 1..{d}")).cast("map<int,double>")
    )
    with_map = parsed.select("y", checked.alias("m"))
    x = F.transform(
        F.sequence(F.lit(1), F.lit(d)),
        lambda j: F.coalesce(F.try_element_at(F.col("m"), j), F.lit(0.0)),
    )
    return with_map.select("y", x.alias("x"))


def write_text_split(df: DataFrame, path: str, is_test, *, line: str = "value") -> None:
    """Write text lines to ``<path>_train`` and ``<path>_test`` by a boolean column."""
    df.filter(~is_test).select(line).write.text(path + "_train")
    df.filter(is_test).select(line).write.text(path + "_test")
