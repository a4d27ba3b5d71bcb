"""Sums of per-shard answers, and the choice of how a shard is solved.

Three routes, from the cheapest:

1. statistics: per-shard matrices by partial aggregation.  Exact for any shard
   size, nothing but ``d x d`` sums is shuffled.  Used for narrow data, for the
   squared loss (whose matrix never changes), for shards too big for a task, and
   wherever these sums are small against the rows that a gather would move.
2. gathered, matrix formed in the task.
3. gathered, matrix-free.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from fitkit.operators.blocks import Block, sum_over_blocks
from fitkit.operators.losses import SQUARED, Loss, Penalty
from fitkit.operators.shards import (
    conjugate_gradient,
    forms_matrix,
    solve_matrix,
    split_stats,
    sum_over_stats,
    svrg,
)
from fitkit.operators.training_set import Evaluation, TrainingSet
from fitkit.plans.epochs import fold_state, in_epochs, run_epochs, start_state, streams

# Passes whose partial sums may weigh as much as the rows, and the usual bytes of an input split.
STATS_PASSES = 16
SPLIT_BYTES = 128 << 20
# Rows below this are gathered: moving them once costs less than a merge in every iteration
# (8.9 against 4.2 seconds for a Newton fit of 400,000 narrow rows).
GATHER_BYTES = 1 << 30
# What a task holds of a gathered shard: its blocks, the ordered copy, and the vectors and products of a solve.
HELD_COPIES = 4


def _tasks(length: int) -> int | None:
    """Short sums over statistics rows go straight to the driver, long ones are merged first."""
    return 1 if length <= 512 else None


class QuadraticTotals:
    """Ridge sums taken once from per-shard statistics; later evaluations need no job.

    Errors are expanded around the least-squares point, where one pass over the rows measures
    them: the sums themselves would cancel where residuals are small against the labels.

    Offers ``evaluate`` and ``line`` like a training set.  Only used for widths at
    which one ``d x d`` matrix is small on the driver.
    """

    def __init__(self, ts: TrainingSet, stats: DataFrame):
        length = ts.d * (ts.d + 1) + 4
        total = sum_over_stats(
            stats, length, _tasks(length), lambda _, s, v: np.concatenate([v, [s, 1.0]])
        )
        self.n, self.m = int(total[-2]), int(total[-1])
        if not self.n:
            raise ValueError("the training table is empty")
        self.gram, slope, _, _ = split_stats(total[:-2], ts.d)
        self.centre = np.linalg.lstsq(self.gram, -slope, rcond=None)[0]
        at = ts.evaluate_once(self.centre, SQUARED, Penalty(), self.n)
        self.centre_error, self.centre_gradient = at.error, at.gradient

    def evaluate(self, w: np.ndarray, loss: Loss, penalty: Penalty) -> Evaluation:
        away = w - self.centre
        bend = self.gram @ away / self.n
        error = self.centre_error + 2.0 * float(self.centre_gradient @ away) + float(away @ bend)
        error = max(0.0, error)
        return Evaluation(
            0.5 * error + penalty.value(w),
            error,
            self.centre_gradient + bend + penalty.gradient(w),
        )

    def line(self, w, p, etas, loss, penalty, *, slopes=False):
        at = [self.evaluate(w - e * p, loss, penalty) for e in etas]
        directional = np.array([p @ e.gradient for e in at]) if slopes else None
        return np.array([e.objective for e in at]), directional, at[0]


def squared_stats(ts: TrainingSet) -> tuple[DataFrame, DataFrame]:
    """Gram matrix and moments per shard: the cached table, to release, and a view to read.

    With fewer shards than shuffle partitions the view drops the empty partitions,
    each of which would otherwise start a Python task in every iteration.
    """
    held = ts.hold(ts.shard_stats(np.zeros(ts.d), SQUARED))
    with ts.block_batches():
        shards = max(1, held.count())
    partitions = int(ts.spark.conf.get("spark.sql.shuffle.partitions"))
    return held, held.coalesce(shards) if shards < partitions else held


def uses_statistics(ts: TrainingSet, loss: Loss, inner: int, hessian: str = "auto") -> bool:
    """Whether shard matrices are summed where the rows lie instead of gathering shard rows.

    ``"free"`` never does.  Otherwise sums are taken for JVM aggregations and for shards that no
    task holds, and where a matrix is formed anyway while the partial sums of ``STATS_PASSES``
    passes, one for each task and shard, weigh less than many rows (``GATHER_BYTES``).
    """
    if hessian == "free":
        return False
    if ts.is_native(loss):
        return True
    d = ts.d
    if d > ts.gram_limit:
        return False
    if ts.has_oversized_shard:
        return True
    n = sum(rows for *_, rows in ts.slots)
    # A gathered shard lies in a task twice while it is put in order.
    if ts.row_bytes * n < GATHER_BYTES and HELD_COPIES * ts.row_bytes * ts.largest_shard <= ts.shard_bytes:
        return False
    if hessian != "matrix" and not forms_matrix(n // ts.m, d, inner, ts.gram_limit):
        return False
    tasks = max(ts.spark.sparkContext.defaultParallelism, n * d * 8 // SPLIT_BYTES)
    return STATS_PASSES * tasks * ts.m * (d * d + d + 2) <= n * d


def lay_out(ts: TrainingSet, loss: Loss, by_stats: bool) -> None:
    """Cache the form that the solves read before the first evaluation, so one copy serves both."""
    if not by_stats:
        ts.gathered
    elif not ts.is_native(loss):
        ts.pure_blocks


def sum_of_answers(
    ts: TrainingSet,
    w: np.ndarray,
    loss: Loss,
    from_matrix: Callable[[np.ndarray, int], np.ndarray],
    from_rows: Callable[[Block], np.ndarray],
    *,
    by_stats: bool,
    stats: DataFrame | None = None,
) -> np.ndarray:
    """``sum_i s_i v_i / sum_i s_i`` over shards.

    ``from_matrix(h, s)`` gets the mean curvature matrix of a shard at ``w``;
    ``from_rows(block)`` gets its rows.
    """
    d = ts.d
    if stats is None and by_stats:
        stats = ts.shard_stats(w, loss)
    if stats is not None:
        return _mean_over_stats(ts, stats, lambda s, v: from_matrix(split_stats(v, d)[0] / s, s))
    return sum_over_shards(ts, lambda b: len(b.y) * from_rows(b)) / ts.n


def _mean_over_stats(ts: TrainingSet, stats: DataFrame, answer) -> np.ndarray:
    """Row-weighted mean of ``answer(s, stats)`` over shards."""

    def term(_, s, v):
        return np.append(s * answer(s, v), s)

    with ts.block_batches():
        total = sum_over_stats(stats, ts.d + 1, _tasks(ts.d), term)
    return total[:-1] / total[-1]


def sum_over_shards(ts: TrainingSet, term: Callable[[Block], np.ndarray]) -> np.ndarray:
    """``sum(term(shard rows))`` over gathered shards; each term is as wide as the model."""
    gathered = ts.gathered
    with ts.block_batches():
        return sum_over_blocks(gathered, ts.shape, ts.d, ts.gather_tasks, term, whole_shards=True)


def average_models(
    ts: TrainingSet,
    loss: Loss,
    *,
    l2: float,
    inner: int = 20,
    rate: float = 1.0,
    seed: int = 0,
    streamed: bool = False,
) -> np.ndarray:
    """One-shot averaging: fit each shard alone, return ``sum_i s_i w_i / n``.

    Ridge shards are solved by conjugate gradient, logistic shards by
    variance-reduced stochastic gradient: in the task that holds the shard, or epoch by
    epoch over its stream where no task can (always with ``streamed``).
    """
    d, zero = ts.d, np.zeros(ts.d)
    if loss is SQUARED:
        if uses_statistics(ts, loss, inner):

            def from_stats(s, v):
                gram, slope, _, _ = split_stats(v, d)
                return solve_matrix(gram / s + l2 * np.eye(d), -slope / s, inner)

            return _mean_over_stats(ts, ts.shard_stats(zero, SQUARED), from_stats)

        def from_rows(b: Block) -> np.ndarray:
            s = len(b.y)
            apply = lambda p: (b.x @ p) @ b.x / s + l2 * p
            return s * conjugate_gradient(apply, b.y @ b.x / s, inner)

    elif streams(ts, streamed):
        blocks = in_epochs(ts, seed)
        ts.check_labels(loss)
        state = start_state(blocks, zero, zero)
        state, chain = run_epochs(ts, blocks, loss, state, passes=inner, rate=rate, ridge=l2)
        total = fold_state(state, d + 1, lambda s, v: np.append(s * v, s))
        chain.close()
        return total[:-1] / total[-1]
    else:

        def from_rows(b: Block) -> np.ndarray:
            fitted = svrg(
                b, loss, zero, passes=inner, rate=rate, ridge=l2, shift=zero, seed=(seed, b.shard)
            )
            return len(b.y) * fitted

    ts.gathered  # taken first: it also carries the label counts
    ts.check_labels(loss)
    return sum_over_shards(ts, from_rows) / ts.n


def starting_point(
    ts: TrainingSet, start, loss: Loss, l2: float, *, inner: int, rate: float, seed: int, streamed: bool = False
) -> np.ndarray:
    """Zeros, a given vector, or ``"average"`` for one-shot model averaging."""
    if start is None:
        return np.zeros(ts.d)
    if isinstance(start, str):
        if start != "average":
            raise ValueError(f"unknown start {start!r}")
        return average_models(ts, loss, l2=l2, inner=inner, rate=rate, seed=seed, streamed=streamed)
    return np.asarray(start, dtype=np.float64).copy()
