"""Step sizes and stop rules (driver-side scalars)."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from fitkit.operators.losses import Loss

# Candidate steps are 4^-k; how many of them depends on the loss (fixed values).
STEP_BASE = 0.25
LOGISTIC_STEPS = 10
SQUARED_STEPS = 3


def step_table(loss: Loss, count: int | None = None) -> np.ndarray:
    default = LOGISTIC_STEPS if loss.labels_are_signs else SQUARED_STEPS
    return STEP_BASE ** np.arange(count or default)


def armijo(
    etas: np.ndarray, objectives: np.ndarray, current: float, slope: float, c: float = 0.01
) -> int:
    """Index of the largest step with ``f(w - eta p) <= f(w) - c eta <p, g>``, else the last."""
    good = np.flatnonzero(objectives <= current - c * etas * slope)
    return int(good[0]) if len(good) else len(etas) - 1


def wolfe(
    etas: np.ndarray,
    objectives: np.ndarray,
    slopes: np.ndarray,
    current: float,
    slope: float,
    c1: float = 0.1,
    c2: float = 0.9,
) -> int:
    """Largest step with sufficient decrease and ``<p, g_new> <= c2 <p, g>``.

    If none passes both tests, the largest with sufficient decrease: where even the
    full step is short, as the first one often is, the table has nothing longer.
    Failing that too, the last.
    """
    decrease = objectives <= current - c1 * etas * slope
    for good in (np.flatnonzero(decrease & (slopes <= c2 * slope)), np.flatnonzero(decrease)):
        if len(good):
            return int(good[0])
    return len(etas) - 1


@dataclass(frozen=True)
class StopRule:
    """When to stop before ``max_iter``.

    ``grad_tol`` is compared with the squared gradient norm divided by the width.  A fit diverges
    when its objective is not finite or ``growth`` times that of the start (or of 1, if larger).
    """

    grad_tol: float = 1e-22
    max_seconds: float = float("inf")
    growth: float = 1e6

    def reason(
        self, grad_norm_sq: float, d: int, objective: float, seconds: float, first: float
    ) -> str | None:
        if not np.isfinite(objective) or objective > self.growth * max(1.0, abs(first)):
            return "diverged"
        if grad_norm_sq < self.grad_tol * d:
            return "converged"
        if seconds > self.max_seconds:
            return "time"
        return None


def timed(stop: StopRule, max_seconds: float | None) -> StopRule:
    """The rule with this time limit, if one is given."""
    return stop if max_seconds is None else replace(stop, max_seconds=max_seconds)
