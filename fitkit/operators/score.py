"""Scoring a table with fitted weights (all built-in expressions)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import dot

NONZERO_ABOVE = 1e-10  # smallest weight that counts as non-zero (fixed value)


def score_rows(df: DataFrame, w: np.ndarray, *, features: str = "x") -> DataFrame:
    """Add ``score = <x, w>``."""
    return df.withColumn("score", dot(F.col(features), w))


def zero_one_error(df: DataFrame, w: np.ndarray, *, label: str = "y") -> DataFrame:
    """One row ``(n, error)``: share of rows with ``y * score <= 0``; a zero score is wrong."""
    wrong = F.when(F.col(label) * F.col("score") <= 0.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return score_rows(df, w).agg(F.count("*").alias("n"), F.avg(wrong).alias("error"))


def mean_squared_error(df: DataFrame, w: np.ndarray, *, label: str = "y") -> DataFrame:
    """One row ``(n, mse)``."""
    residual = F.col(label) - F.col("score")
    return score_rows(df, w).agg(
        F.count("*").alias("n"), F.avg(residual * residual).alias("mse")
    )


def weight_sparsity(weights: DataFrame) -> DataFrame:
    """One row ``(d, nonzero, share)`` for a ``(j, w)`` table."""
    live = F.when(F.abs("w") > NONZERO_ABOVE, 1).otherwise(0)
    return weights.agg(
        F.count("*").alias("d"),
        F.sum(live).alias("nonzero"),
        F.avg(live.cast("double")).alias("share"),
    )
