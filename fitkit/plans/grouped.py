"""One elastic-net least-squares fit per group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.operators.blocks import iter_shards
from fitkit.operators.losses import SQUARED
from fitkit.operators.shards import (
    elastic_net_quadratic,
    elastic_net_rows,
    iter_stats,
    split_stats,
)
from fitkit.operators.training_set import TrainingSet

MODEL_SCHEMA = "shard INT, s BIGINT, w ARRAY<DOUBLE>, objective DOUBLE"


def fit_groups(
    ts: TrainingSet,
    *,
    lam: float,
    sigma: float = 0.0,
    tilt: np.ndarray | None = None,
    sweeps: int = 1000,
) -> DataFrame:
    """Per shard, minimise ``(1/2s)|X'w - y|^2 + lam (0.5 |w|^2 + sigma |w|_1 - <w, tilt>)``.

    A group enters through its Gram matrix and moments, which Spark adds up with
    partial aggregation; a group of any size is exact and no task holds the rows of
    one.  Data too wide for a matrix per group is solved on the rows of each group,
    as long as every group fits a task.  Returns ``(shard, s, w, objective)``, still
    distributed.
    """
    d = ts.d
    tilt = np.zeros(d) if tilt is None else np.asarray(tilt, dtype=np.float64)
    if d > ts.gram_limit:
        return _from_rows(ts, lam, sigma, tilt, sweeps)

    def kernel(batches):
        for shard, s, v in iter_stats(batches):
            gram, slope, half_yy, _ = split_stats(v, d)
            a, b = gram / s + lam * np.eye(d), lam * tilt - slope / s
            w = elastic_net_quadratic(a, b, lam * sigma, sweeps=sweeps)
            value = 0.5 * (w @ a @ w) - b @ w + half_yy / s + lam * sigma * np.abs(w).sum()
            yield _model(shard, s, w, value)

    return ts.shard_stats(np.zeros(d), SQUARED).mapInArrow(kernel, MODEL_SCHEMA)


def _model(shard: int, s: int, w: np.ndarray, objective: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()),
            pa.array([s], pa.int64()),
            pa.array([w.tolist()], pa.list_(pa.float64())),
            pa.array([float(objective)], pa.float64()),
        ],
        ["shard", "s", "w", "objective"],
    )


def _from_rows(ts: TrainingSet, lam, sigma, tilt, sweeps) -> DataFrame:
    if ts.has_oversized_shard:
        raise ValueError(
            f"a group of {ts.d}-wide rows exceeds one task; raise shard_bytes or gram_limit"
        )
    gathered, shape, d = ts.gathered, ts.shape, ts.d

    def kernel(batches):
        for b in iter_shards(batches, shape):
            s, l1 = len(b.y), lam * sigma
            rhs = b.y @ b.x / s + lam * tilt
            w = elastic_net_rows(
                b.x, np.full(s, 1.0 / s), lam, rhs, l1, start=np.zeros(d), sweeps=sweeps
            )
            fit = 0.5 * np.mean((b.x @ w - b.y) ** 2)
            value = fit + lam * (0.5 * w @ w + sigma * np.abs(w).sum() - w @ tilt)
            yield _model(b.shard, s, w, value)

    with ts.block_batches():
        models = ts.hold(gathered.mapInArrow(kernel, MODEL_SCHEMA))
        models.count()
    names = ts.slot_table().select(F.col("shard").alias("name"), F.explode("labels").alias("shard"))
    return models.join(names, "shard").select(F.col("name").alias("shard"), "s", "w", "objective")
