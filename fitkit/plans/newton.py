"""Averaged local Newton (logistic, ridge) and its proximal form (elastic net).

Each shard solves the Newton system of its own curvature against the global
gradient; the shard directions are averaged by row count.  Shards that no task holds
are solved in lockstep: see :mod:`fitkit.operators.lockstep`.
"""

from __future__ import annotations

import numpy as np

from fitkit.operators import lockstep
from fitkit.operators.blocks import Block
from fitkit.operators.losses import LOGISTIC, SQUARED, Loss, Penalty
from fitkit.operators.shards import (
    conjugate_gradient,
    elastic_net_quadratic,
    elastic_net_rows,
    forms_matrix,
    solve_matrix,
)
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.local import (
    QuadraticTotals,
    lay_out,
    squared_stats,
    starting_point,
    sum_of_answers,
    uses_statistics,
)
from fitkit.plans.loop import FitResult, Step, run
from fitkit.plans.steps import StopRule, armijo, step_table

# Weight of the iteration count in the ridge form-or-not rule (fixed value).
RIDGE_FORM_WEIGHT = 0.05


def fit_newton(
    ts: TrainingSet,
    loss: Loss,
    *,
    l2: float,
    max_iter: int,
    inner: int = 100,
    line_search: bool = True,
    hessian: str = "auto",
    start=None,
    rate: float = 1.0,
    seed: int = 0,
    tile: int = 512,
    **loop,
) -> FitResult:
    """Averaged local Newton with at most ``inner`` CG steps per shard and iteration.

    ``hessian`` is ``"matrix"``, ``"free"`` (no matrix is formed) or ``"auto"``.  Ridge in matrix
    form reads the data once: all later evaluations and solves use per-shard Gram matrices; above
    ``gram_limit`` these are tables of ``tile`` x ``tile`` tiles, and CG runs over the tiles.
    ``"lockstep"`` lets all shards take their CG steps together, one pass over the rows a step; it is
    also taken where a shard is too large for a task and no matrix is formed.  ``"tiled"`` always
    keeps ridge matrices as tiles.
    """
    d, gram_limit, penalty = ts.d, ts.gram_limit, Penalty(l2=l2)
    loop.setdefault("stop", StopRule(grad_tol=1e-22 if loss.labels_are_signs else 1e-18))
    if hessian not in ("auto", "matrix", "free", "lockstep", "tiled"):
        raise ValueError(f"unknown hessian form {hessian!r}")
    if hessian == "tiled" and loss is not SQUARED:
        raise ValueError("only the matrix of the squared loss stays the same between iterations")

    held, stats, source, by_stats, products = None, None, ts, True, None
    if loss is SQUARED and _ridge_in_matrix_form(ts, max_iter, inner, hessian):
        if hessian == "tiled" or (d > gram_limit and not ts.is_native(loss)):
            held = ts.hold(ts.shard_tiles(np.zeros(d), loss, tile))
            products = lockstep.tiles_product(held, d, tile, ts.spark.sparkContext.defaultParallelism)
        else:
            held, stats = squared_stats(ts)
            source = QuadraticTotals(ts, stats)
    else:
        by_stats = uses_statistics(ts, loss, inner, hessian)
        lay_out(ts, loss, by_stats or _in_lockstep(ts, by_stats, hessian))
    in_lockstep = products is not None or _in_lockstep(ts, by_stats, hessian)
    if in_lockstep:
        ts.pure_blocks
    ts.check_labels(loss)
    etas = step_table(loss)

    def direction(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        def from_matrix(h, s):
            return solve_matrix(h + l2 * np.eye(d), g, inner)

        def from_rows(b: Block):
            s = len(b.y)
            k = loss.curvature(b.x @ w, b.y) / s
            formed = forms_matrix(s, d, inner, gram_limit) if hessian == "auto" else False
            if formed or (hessian == "matrix"):
                return from_matrix((b.x * k[:, None]).T @ b.x, s)
            return conjugate_gradient(lambda p: (k * (b.x @ p)) @ b.x + l2 * p, g, inner)

        if in_lockstep:
            solver = lockstep.ConjugateGradient
            with ts.block_batches():
                return lockstep.solve_in_lockstep(
                    ts.shard_sizes(), d, l2, lambda: solver(g, inner), solver, products or ts.shard_products(w, loss)
                )
        return sum_of_answers(ts, w, loss, from_matrix, from_rows, by_stats=by_stats, stats=stats)

    def step(t, w, ev):
        p = direction(w, ev.gradient)
        if not line_search:
            return Step(w - p, 1.0)
        values, _, full = source.line(w, p, etas, loss, penalty)
        k = armijo(etas, values, ev.objective, float(p @ ev.gradient))
        return Step(w - etas[k] * p, float(etas[k]), full if k == 0 else None)

    try:
        w0 = starting_point(ts, start, loss, l2, inner=inner, rate=rate, seed=seed)
        return run(
            ts,
            loss,
            penalty,
            w0,
            step,
            max_iter=max_iter,
            evaluate=lambda w: source.evaluate(w, loss, penalty),
            **loop,
        )
    finally:
        if held is not None:
            ts.release(held)


def _in_lockstep(ts: TrainingSet, by_stats: bool, hessian: str) -> bool:
    """Whether all shards are solved together where their rows lie."""
    return hessian == "lockstep" or (not by_stats and ts.has_oversized_shard and not ts.split_shards)


def _ridge_in_matrix_form(ts: TrainingSet, max_iter: int, inner: int, hessian: str) -> bool:
    if hessian in ("free", "lockstep"):
        return False
    if hessian in ("matrix", "tiled") or ts.is_native(SQUARED):
        return True
    if ts.d <= ts.gram_limit and ts.has_oversized_shard:
        return True
    s = sum(rows for *_, rows in ts.slots) / ts.m
    work = RIDGE_FORM_WEIGHT * max_iter * inner
    return work * s >= s * ts.d + work * ts.d


def fit_prox_newton(
    ts: TrainingSet,
    *,
    l1: float,
    l2: float,
    max_iter: int,
    inner: int = 100,
    start=None,
    lockstep_solves: bool = False,
    **loop,
) -> FitResult:
    """Proximal averaged local Newton for elastic-net logistic regression.

    Each shard minimises ``<g,p> + 0.5 p'Hp + l1 |w + p|_1`` by coordinate descent
    (at most ``inner`` sweeps); steps are backtracked until the objective does not rise.
    With ``lockstep_solves``, or where a shard is too large for a task and for a matrix, all shards
    are solved together by active sets and CG, at most ``inner`` passes over the rows.
    """
    loss = LOGISTIC
    d, gram_limit, penalty = ts.d, ts.gram_limit, Penalty(l1=l1, l2=l2)
    etas = step_table(loss)
    by_stats = uses_statistics(ts, loss, inner)
    in_lockstep = _in_lockstep(ts, by_stats, "lockstep" if lockstep_solves else "auto")
    lay_out(ts, loss, by_stats or in_lockstep)
    if in_lockstep:
        ts.pure_blocks
    ts.check_labels(loss)

    def step(t, w, ev):
        g = ev.gradient

        def from_matrix(h, s):
            a = h + l2 * np.eye(d)
            return w - elastic_net_quadratic(a, a @ w - g, l1, start=w, sweeps=inner)

        def from_rows(b: Block):
            s = len(b.y)
            k = loss.curvature(b.x @ w, b.y) / s
            if forms_matrix(s, d, inner, gram_limit):
                return from_matrix((b.x * k[:, None]).T @ b.x, s)
            target = (k * (b.x @ w)) @ b.x + l2 * w - g
            return w - elastic_net_rows(b.x, k, l2, target, l1, start=w, sweeps=inner)

        if in_lockstep:
            solver = lockstep.ElasticNet
            with ts.block_batches():
                p = lockstep.solve_in_lockstep(
                    ts.shard_sizes(), d, l2, lambda: solver(w, g, l1, inner), solver, ts.shard_products(w, loss)
                )
        else:
            p = sum_of_answers(ts, w, loss, from_matrix, from_rows, by_stats=by_stats)
        values, _, full = ts.line(w, p, etas, loss, penalty)
        k = armijo(etas, values, ev.objective, float(p @ g), c=0.0)
        return Step(w - etas[k] * p, float(etas[k]), full if k == 0 else None)

    w0 = starting_point(ts, start, loss, l2, inner=inner, rate=1.0, seed=0)
    return run(ts, loss, penalty, w0, step, max_iter=max_iter, **loop)
