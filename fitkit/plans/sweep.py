"""Experiment sweeps: many trainer settings on one prepared table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.operators.training_set import TrainingSet
from fitkit.plans.batched import run_batched
from fitkit.plans.loop import FitResult


def run_sweep(
    ts: TrainingSet, runs: Mapping[str, Callable[..., FitResult]], *, batched: bool = False, **shared
) -> tuple[DataFrame, dict[str, FitResult]]:
    """Run each ``run_id -> fit(ts, **shared)`` on the same cached table.

    Returns the histories as one table with a ``run_id`` column, and the results.  With ``batched``
    the fits share every pass over the data (see :mod:`fitkit.plans.batched`).
    """
    if batched:
        results, _ = run_batched(ts, runs, **shared)
    else:
        results = {run_id: fit(ts, **shared) for run_id, fit in runs.items()}
    tables = [
        r.history_df().select(F.lit(run_id).alias("run_id"), "*") for run_id, r in results.items()
    ]
    return reduce(DataFrame.unionByName, tables), results
