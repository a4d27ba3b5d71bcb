"""Vector arithmetic on ARRAY<DOUBLE> columns and on unrolled scalar columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Widest array whose elements are written out as separate terms.  Beyond it the
# generated code outgrows the JVM's method limit and repeats work per element.
UNROLL_LIMIT = 16


def literal_vector(values: Sequence[float]) -> Column:
    """A constant ARRAY<DOUBLE> column."""
    return F.array(*[F.lit(float(v)) for v in values])


def weighted_sum(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """``sum_j columns[j] * weights[j]`` as one flat expression."""
    terms = [c * F.lit(float(w)) for c, w in zip(columns, weights)]
    return reduce(lambda a, b: a + b, terms)


def dot(x: Column, weights: Sequence[float]) -> Column:
    """``<x, weights>``: flat arithmetic when narrow, one BLAS product per Arrow batch when wide."""
    d = len(weights)
    if d <= UNROLL_LIMIT:
        return weighted_sum([F.get(x, F.lit(j)) for j in range(d)], weights)
    w = np.asarray(weights, dtype=np.float64)

    @F.arrow_udf("double")
    def product(column: pa.Array) -> pa.Array:
        return pa.array(column_matrix(column, d) @ w)

    return product(x.cast("array<double>"))


def column_matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow list column as an ``(s, d)`` matrix; rows of another width are an error."""
    if column.null_count:
        raise ValueError("a feature array is null")
    widths = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    if len(widths) and not (widths == d).all():
        raise ValueError(f"feature arrays differ in width: expected {d}, found {sorted(set(widths))[:5]}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a feature value is null")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, added term by term when narrow.

    BLAS fuses multiply and add, which moves the last bit; narrow discrete data has
    scores that are exactly zero, and whether such a row counts as a mistake must
    not depend on whether numpy or the JVM added it up.
    """
    if len(w) > UNROLL_LIMIT:
        return x @ w
    total = x[:, 0] * w[0]
    for j in range(1, len(w)):
        total = total + x[:, j] * w[j]
    return total


def matrix_column(values: np.ndarray) -> pa.Array:
    """An ``(s, d)`` matrix as an Arrow list column."""
    s, d = values.shape
    offsets = pa.array(np.arange(s + 1) * d, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def softplus(z: Column) -> Column:
    """``log(1 + exp(z))`` without overflow for any finite ``z``."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sigmoid_slope(z: Column) -> Column:
    """``sigmoid(z) * sigmoid(-z)``, symmetric in ``z`` and finite everywhere."""
    e = F.exp(-F.abs(z))
    return e / ((F.lit(1.0) + e) * (F.lit(1.0) + e))
