"""DANE for logistic regression: gradient-corrected local problems, plainly averaged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fitkit.operators.blocks import Block
from fitkit.operators.losses import LOGISTIC, Penalty
from fitkit.operators.shards import svrg
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.epochs import fold_state, in_epochs, run_epochs, start_state, streams
from fitkit.plans.local import starting_point, sum_over_shards
from fitkit.plans.loop import FitResult, Step, run
from fitkit.plans.steps import armijo, step_table


def fit_dane(
    ts: TrainingSet,
    *,
    l2: float,
    max_iter: int,
    inner: int,
    rate: float,
    line_search: bool = False,
    start=None,
    seed: int = 0,
    streamed: bool = False,
    **loop,
) -> FitResult:
    """Each shard minimises its own objective tilted to the global gradient.

    The local problem is ``f_i(v) + <g - g_i, v>``, solved by ``inner`` passes of
    variance-reduced stochastic gradient from ``w``; the direction is the plain mean
    of ``w - v_i``.  With ``streamed``, or where a shard fits no task, an epoch is two passes over
    the shards' streams, in one seeded order for all iterations.
    """
    loss = LOGISTIC
    penalty, etas = Penalty(l2=l2), step_table(loss)
    # Built before the first evaluation, so one cached copy serves both.
    in_stream = streams(ts, streamed)
    blocks = in_epochs(ts, seed) if in_stream else ts.gathered
    m = ts.m if in_stream else ts.n_slots
    ts.check_labels(loss)

    def step(t, w, ev):
        g = ev.gradient

        def answer(b: Block) -> np.ndarray:
            local = loss.slope(b.x @ w, b.y) @ b.x / len(b.y) + l2 * w
            v = svrg(
                b,
                loss,
                w,
                passes=inner,
                rate=rate,
                ridge=l2,
                shift=g - local,
                seed=(seed, b.shard, t),
            )
            return w - v

        if in_stream:
            p = w - _epochs(ts, blocks, w, g, l2, inner, rate) / m
        else:
            p = sum_over_shards(ts, answer) / m
        if not line_search:
            return Step(w - p, 1.0)
        values, _, full = ts.line(w, p, etas, loss, penalty)
        k = armijo(etas, values, ev.objective, float(p @ g))
        return Step(w - etas[k] * p, float(etas[k]), full if k == 0 else None)

    w0 = starting_point(ts, start, loss, l2, inner=inner, rate=rate, seed=seed, streamed=in_stream)
    return run(ts, loss, penalty, w0, step, max_iter=max_iter, **loop)


def _epochs(ts: TrainingSet, blocks: DataFrame, w, g, l2: float, inner: int, rate: float) -> np.ndarray:
    """The sum over shards of where their epochs from ``w`` end."""

    def shift(at, slope, s):
        return g - (slope / s + l2 * at)

    state = start_state(blocks, w, None)
    state, chain = run_epochs(ts, blocks, LOGISTIC, state, passes=inner, rate=rate, ridge=l2, shift=shift)
    total = fold_state(state, ts.d, lambda s, v: v)
    chain.close()
    return total
