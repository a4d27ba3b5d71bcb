"""Row preparation: recodes, filters, scaling, splits, replication, shards."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitkit.functions.noise import hash_gaussian, hash_uint32
from fitkit.functions.vectors import UNROLL_LIMIT, column_matrix, literal_vector, matrix_column
from fitkit.operators.blocks import fold_rows


def recode_affine(df: DataFrame, shift: float, scale: float, *, label: str = "y") -> DataFrame:
    """``y -> (y - shift) / scale``; ``(1.5, 0.5)`` maps {1,2} and ``(6.5, 2.5)`` {4,9} to -1/+1."""
    return df.withColumn(label, (F.col(label).cast("double") - F.lit(shift)) / F.lit(scale))


def recode_binary(df: DataFrame, positive: Column, *, label: str = "y") -> DataFrame:
    """+1 where the condition holds, -1 elsewhere."""
    return df.withColumn(label, F.when(positive, F.lit(1.0)).otherwise(F.lit(-1.0)))


def keep_classes(df: DataFrame, column: str, classes: Iterable) -> DataFrame:
    """Keep the rows of the named classes (reaches the scan as a pushed filter)."""
    return df.filter(F.col(column).isin(list(classes)))


@dataclass(frozen=True)
class ScaleStats:
    """Fitted scaling: the mean label and the largest absolute value per feature."""

    y_mean: float
    max_abs: np.ndarray

    def to_df(self, spark) -> DataFrame:
        rows = [(j, float(v), self.y_mean) for j, v in enumerate(self.max_abs)]
        return spark.createDataFrame(rows, "j INT, max_abs DOUBLE, y_mean DOUBLE")


def fit_max_abs(df: DataFrame, d: int, *, label: str = "y", features: str = "x") -> ScaleStats:
    """One aggregation pass; narrow data stays in the JVM, wide data goes by Arrow batch."""
    if d <= UNROLL_LIMIT:
        row = df.agg(
            F.avg(label).alias("y_mean"),
            *[F.max(F.abs(F.get(F.col(features), F.lit(j)))).alias(f"m{j}") for j in range(d)],
        ).first()
        return ScaleStats(float(row["y_mean"]), np.array([row[f"m{j}"] for j in range(d)]))
    return fit_max_abs_batched(df, d, label=label, features=features)


def fit_max_abs_batched(
    df: DataFrame, d: int, *, label: str = "y", features: str = "x"
) -> ScaleStats:
    """The fit for wide features: per-batch maxima in numpy, merged by Spark."""

    def partial(batch):
        x = column_matrix(batch.column(1), d)
        y = batch.column(0).to_numpy(zero_copy_only=False)
        return np.concatenate([np.abs(x).max(axis=0), [y.sum(), float(len(y))]])

    def combine(a, b):
        return np.concatenate([np.maximum(a[:d], b[:d]), a[d:] + b[d:]])

    source = df.select(F.col(label).cast("double"), F.col(features).cast("array<double>"))
    total = fold_rows(source, partial, combine, d + 2)
    return ScaleStats(float(total[d] / total[d + 1]), total[:d])


def _scaled(x: Column, inverse: np.ndarray) -> Column:
    @F.arrow_udf("array<double>")
    def scaled(column: pa.Array) -> pa.Array:
        return matrix_column(column_matrix(column, len(inverse)) * inverse)

    return scaled(x)


def apply_max_abs(
    df: DataFrame, stats: ScaleStats, *, label: str = "y", features: str = "x", center: bool = True
) -> DataFrame:
    """Divide features by their fitted maxima and subtract the fitted mean label.

    A feature that is zero in every fitted row maps to zero, not to NaN.  Wide features go by
    Arrow batch, as a literal for each would outgrow the plan.
    """
    if len(stats.max_abs) > UNROLL_LIMIT:
        inverse = np.divide(1.0, stats.max_abs, out=np.zeros_like(stats.max_abs), where=stats.max_abs != 0.0)
        scaled = _scaled(F.col(features).cast("array<double>"), inverse)
    else:
        scaled = F.zip_with(
            F.col(features),
            literal_vector(stats.max_abs),
            lambda v, m: F.when(m == 0.0, F.lit(0.0)).otherwise(v / m),
        )
    out = df.withColumn(features, scaled)
    if center:
        out = out.withColumn(label, F.col(label) - F.lit(stats.y_mean))
    return out


def split_hash(
    df: DataFrame, key: str, *, seed: int = 0, train_percent: int = 80, draws: str = "xxhash"
) -> DataFrame:
    """Random split by a hash of the key: a projection, no shuffle; sizes are approximate."""
    code = hash_uint32(seed, F.col(key)) if draws == "md5" else F.xxhash64(F.lit(seed), F.col(key))
    held_out = F.pmod(code, F.lit(100)) >= F.lit(train_percent)
    return df.withColumn("is_test", held_out)


def split_modulo(df: DataFrame, key: str, *, every: int = 5) -> DataFrame:
    """Every ``every``-th key goes to the test side."""
    return df.withColumn("is_test", F.pmod(F.col(key), F.lit(every)) == 0)


def split_exact(
    df: DataFrame, key: str, *, seed: int = 0, train_fraction: float = 0.8, max_ties: int | None = None
) -> DataFrame:
    """Random split with exactly ``floor(train_fraction * n)`` training rows, whatever ties there are.

    Equivalent to sorting all rows by a random hash of the key, then by key and content, and cutting, but
    without the sort.  Histograms of 65,536 bins locate the hash at the cut, digit by digit, then the key
    among rows of that hash, then the SHA-256 of the content among rows of that key.  Rows that agree in all of it are identical: the
    table then holds as many of them on either side as the cut asks for.  Columns of any type
    that JSON can hold.  ``max_ties`` refuses more rows of one hash than that, if given.
    """
    h = hash_uint32(seed, F.col(key))
    bins = 1 << 16

    def histogram(rows: DataFrame, code: Column) -> list[tuple[int, int]]:
        counts = rows.groupBy(code.alias("b")).count().collect()  # at most 65,536 rows
        return sorted((int(r["b"]), int(r["count"])) for r in counts)

    def cut(counts: list[tuple[int, int]], wanted: int) -> tuple[int, int]:
        """Bin holding the ``wanted``-th row and how many rows lie in earlier bins."""
        before = 0
        for b, c in counts:
            if before + c >= wanted:
                return b, before
            before += c
        return bins, before

    high = F.shiftright(h, 16)
    coarse = histogram(df, high)
    n = sum(c for _, c in coarse)
    n_train = int(np.floor(train_fraction * n))
    if n_train <= 0 or n_train >= n:
        return df.withColumn("is_test", F.lit(n_train <= 0))
    top, before = cut(coarse, n_train)
    fine = histogram(df.filter(high == top), F.pmod(h, F.lit(bins)))
    bottom, inside = cut(fine, n_train - before)
    edge = top * bins + bottom
    wanted, at_edge = n_train - before - inside, dict(fine)[bottom]
    if max_ties is not None and at_edge > max_ties:
        raise ValueError(f"{at_edge} rows share one hash; split_exact with max_ties needs a unique key")
    if at_edge == wanted:
        return df.withColumn("is_test", h > F.lit(edge))

    # Among rows of one hash: by key, as far as keys differ, then by content.
    ties = df.filter(h == edge)
    edge_key, past = None, 0
    for value, count in ties.groupBy(key).count().orderBy(key).toLocalIterator():
        if past + count >= wanted:
            edge_key, wanted, at_edge = value, wanted - past, count
            break
        past += count
    same_key = (h == edge) & F.col(key).eqNullSafe(F.lit(edge_key))
    beyond = F.when(h != edge, h > edge).when(
        ~F.col(key).eqNullSafe(F.lit(edge_key)), F.coalesce(F.col(key) > F.lit(edge_key), F.lit(edge_key is None))
    )
    if at_edge == wanted:
        return df.withColumn("is_test", beyond.otherwise(F.lit(False)))
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    found = ""
    while len(found) < 64:
        rows = df.filter(same_key & content.startswith(found))
        digits = F.conv(F.substring(content, len(found) + 1, 4), 16, 10).cast("long")
        counts = histogram(rows, digits)
        digit, inside = cut(counts, wanted)
        found, wanted, at_edge = found + f"{digit:04x}", wanted - inside, dict(counts)[digit]
        if at_edge == wanted:
            return df.withColumn("is_test", beyond.otherwise(F.substring(content, 1, len(found)) > found))
        if at_edge == 1:
            break
    # What is left is one row many times: its copies are dealt by number.
    whole = df.filter(same_key & content.startswith(found)).limit(1)
    copies = df.sparkSession.range(at_edge).select((F.col("id") >= wanted).alias("is_test"), F.lit(1).alias("__one"))
    dealt = copies.join(F.broadcast(whole.withColumn("__one", F.lit(1))), "__one").select(*[F.col(f"`{c}`") for c in df.columns], "is_test")
    rest = df.filter(~(same_key & content.startswith(found)))
    return rest.withColumn("is_test", beyond.otherwise(content > found)).unionByName(dealt)


def replicate_noise(
    df: DataFrame,
    copies: int,
    sigma: float,
    *,
    key: str = "id",
    features: str = "x",
    seed: int = 0,
    draws: str = "xxhash",
) -> DataFrame:
    """``copies`` noisy copies of each row: ``x_j + sigma * N(0,1)``, no shuffle.

    The draw is keyed by ``(row key, copy, feature)``; the ``copy`` column tells
    the copies apart.
    """
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    noisy = F.transform(
        F.col(features),
        lambda v, j: v + F.lit(sigma) * hash_gaussian(seed, F.col(key), F.col("copy"), j, draws=draws),
    )
    return out.withColumn(features, noisy)


def assign_shards(df: DataFrame, m: int, key: str | Sequence[str], *, hashed: bool = True) -> DataFrame:
    """Add ``shard`` in ``0..m-1`` from the data, never from the physical layout.

    ``hashed=True`` hashes the key columns, which balances shards when the key is
    unique; ``hashed=False`` takes one integer key modulo ``m``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    code = F.xxhash64(*keys) if hashed else F.col(keys[0])
    return df.withColumn("shard", F.pmod(code, F.lit(m)).cast("int"))
