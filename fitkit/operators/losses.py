"""Losses on the linear score ``t = <x, w>``, and the penalty.

A loss is four functions of ``(t, y)``, each in a numpy form for block kernels and
a Column form for plans that stay in the JVM.  Everything else in the package is
written against this protocol, so a new loss is one more subclass.

The objective of a fit is ``mean(value) + l1 * |w|_1 + 0.5 * l2 * |w|^2``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fitkit.functions.vectors import sigmoid, sigmoid_slope, softplus

# A score that is not clearly positive counts as a mistake (fixed value).
MARGIN_FLOOR = 1e-30


class Loss:
    name = ""
    labels_are_signs = False
    max_curvature = 1.0

    def value(self, t, y):
        raise NotImplementedError

    def slope(self, t, y):
        raise NotImplementedError

    def curvature(self, t, y):
        raise NotImplementedError

    def mistake(self, t, y):
        raise NotImplementedError


class LogisticLoss(Loss):
    """``log(1 + exp(-y t))`` with labels -1 and +1."""

    name = "logistic"
    labels_are_signs = True
    max_curvature = 0.25

    def value(self, t, y):
        return np.logaddexp(0.0, -y * t)

    def slope(self, t, y):
        return -0.5 * y * (1.0 - np.tanh(0.5 * y * t))

    def curvature(self, t, y):
        e = np.exp(-np.abs(t))
        return e / ((1.0 + e) * (1.0 + e))

    def mistake(self, t, y):
        return (y * t < MARGIN_FLOOR).astype(np.float64)

    def value_col(self, t: Column, y: Column) -> Column:
        return softplus(-y * t)

    def slope_col(self, t: Column, y: Column) -> Column:
        return -y * sigmoid(-y * t)

    def curvature_col(self, t: Column, y: Column) -> Column:
        return sigmoid_slope(t)

    def mistake_col(self, t: Column, y: Column) -> Column:
        return F.when(y * t < MARGIN_FLOOR, F.lit(1.0)).otherwise(F.lit(0.0))


class SquaredLoss(Loss):
    """``0.5 (t - y)^2``; its error measure is the squared residual."""

    name = "squared"

    def value(self, t, y):
        return 0.5 * (t - y) ** 2

    def slope(self, t, y):
        return t - y

    def curvature(self, t, y):
        return np.ones_like(t)

    def mistake(self, t, y):
        return (t - y) ** 2

    def value_col(self, t: Column, y: Column) -> Column:
        return F.lit(0.5) * (t - y) * (t - y)

    def slope_col(self, t: Column, y: Column) -> Column:
        return t - y

    def curvature_col(self, t: Column, y: Column) -> Column:
        return F.lit(1.0)

    def mistake_col(self, t: Column, y: Column) -> Column:
        return (t - y) * (t - y)


LOGISTIC = LogisticLoss()
SQUARED = SquaredLoss()


@dataclass(frozen=True)
class Penalty:
    l2: float = 0.0
    l1: float = 0.0

    def value(self, w: np.ndarray) -> float:
        return self.l1 * float(np.abs(w).sum()) + 0.5 * self.l2 * float(w @ w)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Gradient of the smooth part."""
        return self.l2 * w


def shrink(v, by):
    """Soft threshold: move ``v`` towards zero by ``by``, stopping at exactly zero."""
    return np.sign(v) * np.maximum(np.abs(v) - by, 0.0)
