"""Consensus ADMM for logistic regression and ridge.

Primal and dual vectors of a shard live in a state table keyed by ``shard``, next
to the data they belong to; only the consensus ``u`` visits the driver.  Every
iteration joins that table to the shard data, which is partitioned and sorted by shard
once and stays where it is, and writes its successor to the checkpoint folder, so lineage
stays one step long and a lost executor costs one iteration's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import scores
from fitkit.operators.blocks import (
    PARTIAL_SCHEMA,
    Shape,
    fold_partials,
    iter_shards,
    partial_batch,
)
from fitkit.operators.losses import SQUARED, Loss, Penalty
from fitkit.operators.shards import conjugate_gradient, iter_stats, solve_matrix, split_stats, svrg
from fitkit.operators.training_set import TrainingSet, as_evaluation
from fitkit.plans.epochs import STATE_SCHEMA as EPOCH_SCHEMA
from fitkit.plans.epochs import _cells as epoch_cells
from fitkit.plans.epochs import _state_batch as epoch_state
from fitkit.plans.epochs import in_epochs, run_epochs, streams
from fitkit.plans.local import QuadraticTotals, squared_stats, starting_point
from fitkit.plans.loop import FitResult, History
from fitkit.plans.steps import StopRule, timed
from fitkit.session import TableChain, checkpoint_dir

STATE_SCHEMA = "shard INT, w ARRAY<DOUBLE>, a ARRAY<DOUBLE>, sums ARRAY<DOUBLE>"
DEFAULT_RHO = 0.1  # times l2 (fixed value)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False) for v in column]


def _state_batch(shard: int, *vectors: np.ndarray) -> pa.RecordBatch:
    arrays = [
        pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.float64()))
        for v in vectors
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), *arrays], ["shard", "w", "a", "sums"]
    )


def _shards_with_state(batches: Iterator[pa.RecordBatch], shape: Shape):
    """Whole shards with their ``(w, a)``, from joined rows grouped by shard."""
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def watched():
        for batch in batches:
            names = batch.schema.names
            ws, duals = (_vectors(batch.column(names.index(c))) for c in ("w", "a"))
            for shard, w, a in zip(batch.column(names.index("shard")).to_pylist(), ws, duals):
                seen.setdefault(shard, (w.copy(), a.copy()))
            yield batch

    for block in iter_shards(watched(), shape):
        yield block, *seen.pop(block.shard)


def _keyed_stats(ts: TrainingSet) -> tuple[DataFrame, DataFrame, QuadraticTotals]:
    """Per-shard sums as cached, partitioned and sorted by shard in Spark's eyes, and their totals.

    They move once.  A join on ``shard`` then moves the other side only.
    """
    held, stats = squared_stats(ts)
    source = QuadraticTotals(ts, stats)
    parts = min(source.m, int(ts.spark.conf.get("spark.sql.shuffle.partitions")))
    return held, ts.hold(stats.repartition(parts, "shard").sortWithinPartitions("shard")), source


def fit_admm(
    ts: TrainingSet,
    loss: Loss,
    *,
    l2: float,
    max_iter: int,
    inner: int,
    rho: float | None = None,
    rate: float = 1.0,
    start=None,
    seed: int = 0,
    streamed: bool = False,
    held_out: TrainingSet | None = None,
    stop: StopRule | None = None,
    max_seconds: float | None = None,
    keep_path: bool = True,
) -> FitResult:
    """ADMM with the consensus vector ``u`` as the model.

    Shard ``i`` minimises ``(m/n) sum_i loss + 0.5 rho |w + a_i - u|^2``, so shards
    count by their rows and the fixed point is the optimum of the whole table also
    when shard sizes differ.  Ridge shards are solved by ``inner`` CG steps, logistic
    shards by ``inner`` passes of variance-reduced stochastic gradient.  Duals start
    at zero in every call.  With ``streamed``, or where a logistic shard fits no task, these
    passes walk over the shards' streams, in one seeded order for all rounds.
    """
    checkpoint_dir(ts.spark)
    d, penalty = ts.d, Penalty(l2=l2)
    rho = DEFAULT_RHO * l2 if rho is None else rho
    if rho <= 0.0:
        raise ValueError("rho must be positive; give it when l2 is zero")
    stop = timed(stop or StopRule(grad_tol=1e-22 if loss.labels_are_signs else 1e-18), max_seconds)
    by_stats = loss is SQUARED and ts.d <= ts.gram_limit
    in_stream = loss is not SQUARED and streams(ts, streamed)
    cached = []
    if by_stats:
        held, data, source = _keyed_stats(ts)
        cached, n, m = [held, data], source.n, source.m
    elif in_stream:
        data, m, source = in_epochs(ts, seed), ts.m, ts
        ts.check_labels(loss)
        n = ts.n
    else:
        data, m, source = ts.joinable, ts.n_slots, ts
        ts.check_labels(loss)
        n = ts.n
    shape = ts.shape

    def solve(shard_data, u, w, a, t):
        """New primal of one shard and ``[gradient, loss, error]`` sums at ``u``."""
        if by_stats:
            shard, s, v = shard_data
            gram, slope, half_yy, _ = split_stats(v, d)
            weight = m / n
            lhs = weight * gram + rho * np.eye(d)
            new = solve_matrix(lhs, -weight * slope + rho * (u - a), inner, start=w)
            gu = gram @ u
            sse = max(0.0, float(u @ gu + 2.0 * (slope @ u) + 2.0 * half_yy))
            return new, np.concatenate([gu + slope, [0.5 * sse, sse]])
        b = shard_data
        s, weight = len(b.y), m * len(b.y) / n
        at_u = scores(b.x, u)
        sums = np.concatenate(
            [
                loss.slope(at_u, b.y) @ b.x,
                [loss.value(at_u, b.y).sum(), loss.mistake(at_u, b.y).sum()],
            ]
        )
        if loss is SQUARED:
            apply = lambda p: weight / s * ((b.x @ p) @ b.x) + rho * p
            rhs = weight / s * (b.y @ b.x) + rho * (u - a)
            return conjugate_gradient(apply, rhs, inner, start=w), sums
        new = svrg(
            b,
            loss,
            w,
            passes=inner,
            rate=rate,
            ridge=rho,
            shift=rho * (a - u),
            loss_weight=weight,
            seed=(seed, b.shard, t),
        )
        return new, sums

    def advance(state: DataFrame, u: np.ndarray, u_old: np.ndarray | None, t: int) -> DataFrame:
        """One ADMM round; the dual update of the previous round happens on the way in."""

        def rows(batches):
            if not by_stats:
                yield from _shards_with_state(batches, shape)
                return
            for batch in batches:
                names = batch.schema.names
                ws = _vectors(batch.column(names.index("w")))
                duals = _vectors(batch.column(names.index("a")))
                for i, item in enumerate(iter_stats(iter([batch]))):
                    yield item, ws[i], duals[i]

        def kernel(batches):
            for shard_data, w, a in rows(batches):
                if u_old is not None:
                    a = a + w - u
                new, sums = solve(shard_data, u, w, a, t)
                yield _state_batch(int(shard_data[0]), new, a, sums)

        # A merge join: the shard data is already partitioned and sorted by shard, so
        # only the state moves, and it may be larger than what a broadcast can carry.
        joined = data.join(state.select("shard", "w", "a").hint("merge"), "shard")
        return chain.put(joined.mapInArrow(kernel, STATE_SCHEMA))

    def walk(state: DataFrame, u: np.ndarray, u_old: np.ndarray | None) -> DataFrame:
        """The same round where shards are streams: the epochs, then the sums at ``u`` once for all."""

        def to_solve(batches):
            for batch in batches:
                names = batch.schema.names
                sizes = batch.column(names.index("s")).to_pylist()
                ws, duals = (_vectors(batch.column(names.index(c))) for c in ("w", "a"))
                for shard, s, w, a in zip(batch.column(names.index("shard")).to_pylist(), sizes, ws, duals):
                    a = a if u_old is None else a + w - u
                    yield epoch_state(shard, s, w, None, rho * (a - u))

        def back(batches):
            for batch in batches:
                for shard, w, moved in zip(batch.column(0).to_pylist(), epoch_cells(batch, "w"), epoch_cells(batch, "shift")):
                    yield _state_batch(shard, w, moved / rho + u, np.zeros(0))

        sized = state.join(sizes, "shard").select("shard", "s", "w", "a")
        solved, passes = run_epochs(
            ts,
            data,
            loss,
            sized.mapInArrow(to_solve, EPOCH_SCHEMA),
            passes=inner,
            rate=rate,
            ridge=rho,
            weight=lambda s: m * s / n,
        )
        out = chain.put(solved.mapInArrow(back, STATE_SCHEMA))
        passes.close()
        return out

    def totals(state: DataFrame) -> np.ndarray:
        """Sums over shards of ``w + a`` and of the sums at ``u``."""

        def kernel(batches):
            total = np.zeros(2 * d + 2)
            for batch in batches:
                for w, a, sums in zip(*(_vectors(batch.column(i)) for i in range(3))):
                    total[:d] += w + a
                    total[d:] += sums if len(sums) else 0.0
            yield partial_batch(total)

        partials = state.select("w", "a", "sums").mapInArrow(kernel, PARTIAL_SCHEMA)
        return fold_partials(partials, np.add, 2 * d + 2, m)

    history = History(loss, held_out, keep_path)
    u = starting_point(ts, start, loss, l2, inner=inner, rate=rate, seed=seed, streamed=in_stream)

    def first(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield _state_batch(shard, u, np.zeros(d), np.zeros(0))

    chain = TableChain(ts.spark, "admm")
    with ts.block_batches():
        sizes = chain.put(data.groupBy("shard").agg(F.sum("s").cast("bigint").alias("s"))) if in_stream else None
        state = chain.put(data.select("shard").distinct().mapInArrow(first, STATE_SCHEMA))
    chain.paths = chain.paths[-1:]  # the sizes stay
    u_old, reason = None, "max_iter"
    try:
        for t in range(max_iter):
            with ts.block_batches():
                state = walk(state, u, u_old) if in_stream else advance(state, u, u_old, t)
                total = totals(state)
            if in_stream:
                ev = source.evaluate(u, loss, penalty)
            else:
                ev = as_evaluation(total[d:], n, u, penalty)
            history.add(u, ev.objective, ev.error, ev.grad_norm_sq)
            early = stop.reason(
                ev.grad_norm_sq, d, ev.objective, history.seconds(), history.rows[0]["objective"]
            )
            if early:
                reason = early
                break
            history.rows[-1]["step"] = 1.0
            u_old, u = u, total[:d] / m * (rho / (l2 + rho))
        else:
            ev = source.evaluate(u, loss, penalty)
            history.add(u, ev.objective, ev.error, ev.grad_norm_sq)
    finally:
        chain.close()
        for df in cached:
            ts.release(df)
    return FitResult(ts.spark, u, reason, history.rows, history.path)
