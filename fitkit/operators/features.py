"""Random Fourier features and the kernel bandwidth."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitkit.functions.noise import hash_gaussian_value, hash_uniform_value
from fitkit.functions.vectors import UNROLL_LIMIT, column_matrix, literal_vector, matrix_column
from fitkit.operators.blocks import fold_rows

# Seeds of the projection and of the phases (fixed values).
PROJECTION_SEED = 1234
PHASE_SEED = 4321
MAX_HASHED = 1 << 20  # draws taken one md5 at a time on the driver
MAPPED_BYTES = 64 << 20  # mapped rows that leave a worker at once
MAX_TABLE_BYTES = 1 << 30  # projection kept by one Python worker


@dataclass(frozen=True)
class RandomFourier:
    """``sqrt(2/D) cos(Z x + v)`` with ``Z ~ N(0, 1/sigma^2)`` and ``v ~ U[0, 2 pi)``.

    One map for every row of every table.  ``draws="generator"`` makes each worker
    rebuild ``Z`` from the seeds, so nothing is broadcast; ``draws="hash"`` takes
    the draws from md5, which any SQL engine can repeat.
    """

    width: int
    size: int
    sigma: float
    draws: str = "generator"

    def __post_init__(self):
        if self.draws not in ("generator", "hash"):
            raise ValueError(f"unknown draws {self.draws!r}")
        if self.draws == "hash" and self.width * self.size > MAX_HASHED:
            raise ValueError("hashed draws are for small maps; use draws='generator'")

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """``(Z, v)``."""
        if self.draws == "hash":
            z = [
                [hash_gaussian_value(PROJECTION_SEED, i, j) for j in range(self.width)]
                for i in range(self.size)
            ]
            v = [2.0 * math.pi * hash_uniform_value(PHASE_SEED, i) for i in range(self.size)]
            return np.array(z) / self.sigma, np.array(v)
        z = np.random.default_rng(PROJECTION_SEED).standard_normal((self.size, self.width))
        v = np.random.default_rng(PHASE_SEED).uniform(0.0, 2.0 * math.pi, self.size)
        return z / self.sigma, v

    def bind(self):
        """A function on ``(s, width)`` matrices, holding ``Z`` for the life of one task."""
        if 8 * self.width * self.size > MAX_TABLE_BYTES:
            raise ValueError("the projection does not fit a worker; lower the feature count")
        z, v = self.table()
        scale = math.sqrt(2.0 / self.size)
        return lambda x: np.cos(x @ z.T + v) * scale


def random_fourier(df: DataFrame, m: RandomFourier, *, features: str = "x") -> DataFrame:
    """Replace ``features`` by its random Fourier map, BLAS products of bounded size per Arrow batch."""

    @F.arrow_udf("array<double>")
    def mapped(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = m.bind()
        rows = max(1, MAPPED_BYTES // (8 * m.size))
        for column in columns:
            x = column_matrix(column, m.width)
            for at in range(0, max(1, len(x)), rows):
                yield matrix_column(apply(x[at : at + rows]))

    return df.withColumn(features, mapped(F.col(features).cast("array<double>")))


def random_fourier_native(df: DataFrame, m: RandomFourier, *, features: str = "x") -> DataFrame:
    """The same map inside the JVM, by array functions over a constant projection."""
    z, v = m.table()
    scale = math.sqrt(2.0 / m.size)
    projection = F.array(
        *[
            F.struct(literal_vector(row).alias("z"), F.lit(float(phase)).alias("v"))
            for row, phase in zip(z, v)
        ]
    )

    def feature(row):
        products = F.zip_with(F.col(features), row["z"], lambda a, b: a * b)
        score = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
        return F.lit(scale) * F.cos(score + row["v"])

    return df.withColumn(features, F.transform(projection, feature))


def bandwidth(df: DataFrame, d: int, *, features: str = "x") -> DataFrame:
    """One row ``(n, mean_sq_dist, sigma)`` over all pairs of rows, in one linear pass.

    ``mean |xi - xj|^2`` over all ordered pairs, self pairs included, is twice the
    summed population variance of the features; ``sigma`` is its square root.
    Wide data is summed per Arrow batch with the pairwise mean and deviation merge.
    """
    if d <= UNROLL_LIMIT:
        spread = [F.var_pop(F.get(F.col(features), F.lit(j)).cast("double")) for j in range(d)]
        row = df.agg(
            F.count("*").alias("n"), (F.lit(2.0) * sum(spread[1:], spread[0])).alias("mean_sq_dist")
        )
        return row.withColumn("sigma", F.sqrt("mean_sq_dist"))

    def partial(batch):
        x = column_matrix(batch.column(0), d)
        mean = x.mean(axis=0)
        return np.concatenate([[float(len(x))], mean, [((x - mean) ** 2).sum()]])

    def combine(a, b):
        n = a[0] + b[0]
        gap = b[1:-1] - a[1:-1]
        deviation = a[-1] + b[-1] + float(gap @ gap) * a[0] * b[0] / n
        return np.concatenate([[n], a[1:-1] + gap * (b[0] / n), [deviation]])

    source = df.select(F.col(features).cast("array<double>"))
    total = fold_rows(source, partial, combine, d + 2)
    value = 2.0 * float(total[-1]) / float(total[0])
    return df.sparkSession.createDataFrame(
        [(int(total[0]), value, math.sqrt(value))], "n BIGINT, mean_sq_dist DOUBLE, sigma DOUBLE"
    )


def bandwidth_by_shard(df: DataFrame, *, features: str = "x") -> DataFrame:
    """The same within each shard, over all its rows, and the mean over shards."""
    long = df.select("shard", F.posexplode(features).alias("j", "v"))
    spread = long.groupBy("shard", "j").agg(F.count("*").alias("s"), F.var_pop("v").alias("v"))
    per = spread.groupBy("shard").agg(F.max("s").alias("s"), (F.sum("v") * 2.0).alias("v"))
    return per.agg(F.sum("s").alias("n"), F.avg("v").alias("mean_sq_dist")).withColumn(
        "sigma", F.sqrt("mean_sq_dist")
    )
