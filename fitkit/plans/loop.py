"""The driver loop shared by all trainers.

A trainer supplies one function that maps the current state to the next one.  Row
``t`` of the history is the state before step ``t``; one more row describes the
final weights.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fitkit.operators.losses import Loss, Penalty, shrink
from fitkit.operators.training_set import Evaluation, TrainingSet
from fitkit.plans.steps import StopRule, timed

HISTORY_SCHEMA = (
    "iter INT, objective DOUBLE, train_error DOUBLE, test_error DOUBLE, "
    "grad_norm_sq DOUBLE, step DOUBLE, seconds DOUBLE"
)


@dataclass
class FitResult:
    """Fitted weights, per-iteration history, and why the loop ended."""

    spark: SparkSession
    w: np.ndarray
    stopped: str
    history: list[dict] = field(default_factory=list)
    path: list[np.ndarray] = field(default_factory=list)

    @property
    def objective(self) -> float:
        return self.history[-1]["objective"]

    def weights_df(self) -> DataFrame:
        rows = [(j, float(v)) for j, v in enumerate(self.w)]
        return self.spark.createDataFrame(rows, "j INT, w DOUBLE")

    def history_df(self) -> DataFrame:
        names = [part.split()[0] for part in HISTORY_SCHEMA.split(", ")]
        rows = [tuple(r[n] for n in names) for r in self.history]
        return self.spark.createDataFrame(rows, HISTORY_SCHEMA)


def stationarity(w: np.ndarray, gradient: np.ndarray, l1: float) -> float:
    """Squared norm of the smallest subgradient; the plain gradient norm when ``l1`` is 0."""
    if l1 == 0.0:
        return float(gradient @ gradient)
    sub = np.where(w != 0.0, gradient + l1 * np.sign(w), shrink(gradient, l1))
    return float(sub @ sub)


@dataclass(frozen=True)
class Step:
    """What a trainer returns: new weights, the step size, and their evaluation if known."""

    w: np.ndarray
    size: float | None = None
    evaluation: Evaluation | None = None


class History:
    """Collects rows; time spent on passes over the held-out table alone is not charged to training."""

    def __init__(self, loss: Loss, held_out: TrainingSet | None, keep_path: bool):
        self.loss, self.held_out, self.keep_path = loss, held_out, keep_path
        self.rows: list[dict] = []
        self.path: list[np.ndarray] = []
        self._start = time.monotonic()
        self._excluded = 0.0

    def seconds(self) -> float:
        return time.monotonic() - self._start - self._excluded

    def add(
        self,
        w: np.ndarray,
        objective: float,
        error: float,
        grad_norm_sq: float,
        test_error: float | None = None,
    ) -> None:
        seconds = self.seconds()
        if self.held_out is not None and test_error is None:
            before = time.monotonic()
            test_error = self.held_out.mean_error(w, self.loss)
            self._excluded += time.monotonic() - before
        self.rows.append(
            {
                "iter": len(self.rows),
                "objective": float(objective),
                "train_error": float(error),
                "test_error": test_error,
                "grad_norm_sq": float(grad_norm_sq),
                "step": None,
                "seconds": seconds,
            }
        )
        if self.keep_path:
            self.path.append(w.copy())


def run(
    ts: TrainingSet,
    loss: Loss,
    penalty: Penalty,
    start: np.ndarray,
    step: Callable[[int, np.ndarray, Evaluation], Step],
    *,
    max_iter: int,
    evaluate: Callable[[np.ndarray], Evaluation] | None = None,
    held_out: TrainingSet | None = None,
    stop: StopRule | None = None,
    max_seconds: float | None = None,
    keep_path: bool = True,
) -> FitResult:
    """Iterate ``step`` from ``start`` until a stop rule or ``max_iter``.

    The error on ``held_out`` is measured in the pass that evaluates a state where the table can
    track it, and else by a pass of its own.
    """
    stop = timed(stop or StopRule(), max_seconds)
    evaluate = evaluate or (lambda w: ts.evaluate(w, loss, penalty))
    history = History(loss, held_out, keep_path)
    w, known, reason = start, None, "max_iter"
    tracked = held_out is not None and ts.track(held_out, loss)
    try:
        for t in range(max_iter + 1):
            ev = known or evaluate(w)
            norm = stationarity(w, ev.gradient, penalty.l1)
            history.add(w, ev.objective, ev.error, norm, ev.held_error)
            early = stop.reason(
                norm, ts.d, ev.objective, history.seconds(), history.rows[0]["objective"]
            )
            if early or t == max_iter:
                reason = early or reason
                break
            out = step(t, w, ev)
            history.rows[-1]["step"] = out.size
            w, known = out.w, out.evaluation
    finally:
        if tracked:
            ts.untrack()
    return FitResult(ts.spark, w, reason, history.rows, history.path)
