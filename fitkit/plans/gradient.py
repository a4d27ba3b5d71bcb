"""Trainers that need only global sums: momentum, L-BFGS, CG, FISTA.

None of them shuffles the training rows; one iteration is one or two aggregations.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from fitkit.operators.losses import LOGISTIC, SQUARED, Loss, Penalty, shrink
from fitkit.operators.training_set import Evaluation, TrainingSet
from fitkit.plans.local import starting_point
from fitkit.plans.loop import FitResult, Step, run
from fitkit.plans.steps import StopRule, step_table, wolfe

CURVATURE_FLOOR = 1e-12


def fit_momentum(
    ts: TrainingSet,
    loss: Loss,
    *,
    l2: float,
    max_iter: int,
    rate: float,
    momentum: float = 0.95,
    start=None,
    inner: int = 20,
    seed: int = 0,
    **loop,
) -> FitResult:
    """Heavy-ball gradient descent: ``v = momentum v + g``, ``w -= rate v``."""
    ts.prepare(loss).check_labels(loss)
    velocity = np.zeros(ts.d)

    def step(t, w, ev):
        nonlocal velocity
        velocity = momentum * velocity + ev.gradient
        return Step(w - rate * velocity, rate)

    w0 = starting_point(ts, start, loss, l2, inner=inner, rate=rate, seed=seed)
    return run(ts, loss, Penalty(l2=l2), w0, step, max_iter=max_iter, **loop)


def two_loop(g: np.ndarray, pairs) -> np.ndarray:
    """Quasi-Newton ascent direction from ``(s, y, <s,y>)`` pairs, oldest first."""
    p = g.copy()
    if not pairs:
        return p
    kept = []
    for s, y, sy in reversed(pairs):
        a = float(s @ p) / sy
        kept.append(a)
        p -= a * y
    s, y, sy = pairs[-1]
    p *= sy / float(y @ y)
    for (s, y, sy), a in zip(pairs, reversed(kept)):
        p += (a - float(y @ p) / sy) * s
    return p


def fit_lbfgs(
    ts: TrainingSet,
    loss: Loss,
    *,
    l2: float,
    max_iter: int,
    memory: int = 10,
    start=None,
    inner: int = 20,
    rate: float = 1.0,
    seed: int = 0,
    **loop,
) -> FitResult:
    """L-BFGS with a Wolfe test over a fixed table of steps.

    The table pass also returns the gradient at the full step, so an iteration that
    takes it costs one pass.
    """
    ts.prepare(loss).check_labels(loss)
    penalty = Penalty(l2=l2)
    etas = step_table(loss)
    pairs: deque = deque(maxlen=memory)
    last: list[np.ndarray] = []
    loop.setdefault("stop", StopRule(grad_tol=1e-22 if loss.labels_are_signs else 1e-18))

    def step(t, w, ev):
        g = ev.gradient
        if last:
            s, y = w - last[0], g - last[1]
            sy = float(s @ y)
            if sy > CURVATURE_FLOOR * float(y @ y):
                pairs.append((s, y, sy))
        last[:] = [w, g]
        p = two_loop(g, pairs)
        slope = float(p @ g)
        values, slopes, full = ts.line(w, p, etas, loss, penalty, slopes=True)
        k = wolfe(etas, values, slopes, ev.objective, slope)
        return Step(w - etas[k] * p, float(etas[k]), full if k == 0 else None)

    w0 = starting_point(ts, start, loss, l2, inner=inner, rate=rate, seed=seed)
    return run(ts, loss, penalty, w0, step, max_iter=max_iter, **loop)


def fit_cg(
    ts: TrainingSet,
    *,
    l2: float,
    max_iter: int,
    start=None,
    inner: int = 20,
    refresh: int = 5,
    **loop,
) -> FitResult:
    """Conjugate gradient on ``(X X' + n l2 I) w = X y``; one pass per iteration.

    The objective, error and gradient of an iterate follow from the residual recurrence.  It
    drifts, so every ``refresh``-th iterate, and one whose residual has fallen to a millionth of
    what it was when last measured, is evaluated by a pass of its own.
    """
    penalty, n = Penalty(l2=l2), ts.prepare(SQUARED).n
    loop.setdefault("stop", StopRule(grad_tol=1e-18 / n**2))
    w0 = starting_point(ts, start, SQUARED, l2, inner=inner, rate=1.0, seed=0)
    direction: list[np.ndarray] = []
    measured: list[float] = []

    def step(t, w, ev):
        r = -n * ev.gradient
        if not direction:
            direction.append(r)
            measured.append(float(r @ r))
        p, rr = direction[0], float(r @ r)
        ap = ts.gram_apply(p) + n * l2 * p
        alpha = rr / float(p @ ap)
        new_w, new_r = w + alpha * p, r - alpha * ap
        direction[0] = new_r + (float(new_r @ new_r) / rr) * p
        if (t + 1) % refresh == 0 or float(new_r @ new_r) <= 1e-12 * measured[0]:
            measured[0] = float(new_r @ new_r)
            return Step(new_w, alpha, ts.evaluate(new_w, SQUARED, penalty))
        objective = ev.objective - 0.5 * alpha * rr / n
        error = max(0.0, 2.0 * (objective - penalty.value(new_w)))
        return Step(new_w, alpha, Evaluation(objective, error, -new_r / n))

    return run(ts, SQUARED, penalty, w0, step, max_iter=max_iter, **loop)


def fit_fista(
    ts: TrainingSet,
    *,
    l1: float,
    l2: float,
    max_iter: int,
    lipschitz: float,
    l2_in_prox: bool = False,
    start=None,
    **loop,
) -> FitResult:
    """Accelerated proximal gradient for elastic-net logistic regression.

    The ridge term sits in the smooth part, or in the proximal map with
    ``l2_in_prox``; both minimise the same objective.  One pass per iteration
    evaluates the iterate (for the history) and the extrapolated point together.
    """
    loss = LOGISTIC
    ts.prepare(loss).check_labels(loss)
    penalty, smooth = Penalty(l1=l1, l2=l2), Penalty(l2=l2)
    state = {"ahead": None, "t": 1.0, "gradient": None}

    def loss_gradient(ev: Evaluation, at: np.ndarray) -> np.ndarray:
        g = ev.gradient
        return g - smooth.gradient(at) if l2_in_prox else g

    def step(t, w, ev):
        if state["ahead"] is None:
            state["ahead"], state["gradient"] = w, loss_gradient(ev, w)
        moved = state["ahead"] - state["gradient"] / lipschitz
        new = shrink(moved, l1 / lipschitz)
        if l2_in_prox:
            new = new / (1.0 + l2 / lipschitz)
        grown = 0.5 * (1.0 + math.sqrt(1.0 + 4.0 * state["t"] ** 2))
        ahead = new + ((state["t"] - 1.0) / grown) * (new - w)
        at_new, at_ahead = ts.evaluate_all([new, ahead], loss, penalty)
        state.update(ahead=ahead, t=grown, gradient=loss_gradient(at_ahead, ahead))
        return Step(new, 1.0 / lipschitz, at_new)

    w0 = starting_point(ts, start, loss, l2, inner=20, rate=1.0, seed=0)
    return run(ts, loss, penalty, w0, step, max_iter=max_iter, **loop)
