"""Ready-made experiments: read libsvm files, prepare, sweep trainers, report test errors.

Each preset fixes a recode, a feature map and a grid of trainer settings.  Paths,
shard count and feature count are the caller's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fitkit.operators.features import RandomFourier
from fitkit.operators.losses import LOGISTIC, SQUARED, Loss
from fitkit.operators.prepare import (
    apply_max_abs,
    assign_shards,
    fit_max_abs,
    keep_classes,
    recode_affine,
)
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.admm import fit_admm
from fitkit.plans.dane import fit_dane
from fitkit.plans.gradient import fit_cg, fit_fista, fit_lbfgs, fit_momentum
from fitkit.plans.loop import FitResult
from fitkit.plans.newton import fit_newton, fit_prox_newton
from fitkit.plans.sweep import run_sweep
from fitkit.sources import read_libsvm

Fit = Callable[..., FitResult]


def newton(loss: Loss, l2: float, iters: int, inner: int, line_search: bool = True) -> Fit:
    return lambda ts, **kw: fit_newton(
        ts, loss, l2=l2, max_iter=iters, inner=inner, line_search=line_search, **kw
    )


def dane(l2: float, iters: int, inner: int, rate: float) -> Fit:
    return lambda ts, **kw: fit_dane(ts, l2=l2, max_iter=iters, inner=inner, rate=rate, **kw)


def momentum(l2: float, iters: int, rate: float, beta: float) -> Fit:
    return lambda ts, **kw: fit_momentum(
        ts, LOGISTIC, l2=l2, max_iter=iters, rate=rate, momentum=beta, **kw
    )


def lbfgs(loss: Loss, l2: float, iters: int, memory: int) -> Fit:
    return lambda ts, **kw: fit_lbfgs(ts, loss, l2=l2, max_iter=iters, memory=memory, **kw)


def admm(loss: Loss, l2: float, iters: int, inner: int) -> Fit:
    return lambda ts, **kw: fit_admm(ts, loss, l2=l2, max_iter=iters, inner=inner, **kw)


def cg(l2: float, iters: int) -> Fit:
    return lambda ts, **kw: fit_cg(ts, l2=l2, max_iter=iters, **kw)


def prox_newton(l1: float, l2: float, iters: int, inner: int) -> Fit:
    return lambda ts, **kw: fit_prox_newton(ts, l1=l1, l2=l2, max_iter=iters, inner=inner, **kw)


def fista(l1: float, l2: float, iters: int, lipschitz: float) -> Fit:
    return lambda ts, **kw: fit_fista(
        ts, l1=l1, l2=l2, max_iter=iters, lipschitz=lipschitz, **kw
    )


@dataclass(frozen=True)
class Experiment:
    """What one preset fixes.

    ``recode`` is the affine label map ``(shift, scale)``, ``classes`` the labels
    kept, ``sigma`` the kernel width of the random features (None: raw features),
    ``scale`` whether features are max-abs scaled and labels centred, ``max_seconds`` the
    time after which a fit takes no further iteration.
    """

    loss: Loss
    grid: dict[str, Fit]
    recode: tuple[float, float] | None = None
    classes: tuple[float, ...] | None = None
    sigma: float | None = None
    scale: bool = False
    max_seconds: float | None = None


# Labels, kernel widths, penalties, iteration grids and time limits of the presets.
EXPERIMENTS = {
    "covtype": Experiment(
        LOGISTIC,
        {
            "newton_120_30": newton(LOGISTIC, 1e-4, 120, 30),
            "newton_60_100": newton(LOGISTIC, 1e-4, 60, 100),
            "newton_30_300": newton(LOGISTIC, 1e-4, 30, 300),
            "dane_60_30": dane(1e-4, 60, 30, 10.0),
            "dane_20_100": dane(1e-4, 20, 100, 10.0),
            "dane_20_300": dane(1e-4, 20, 300, 10.0),
            "momentum_0.95": momentum(1e-4, 3000, 10.0, 0.95),
            "momentum_0.99": momentum(1e-4, 3000, 10.0, 0.99),
            "lbfgs_300": lbfgs(LOGISTIC, 1e-4, 500, 300),
        },
        recode=(1.5, 0.5),
        sigma=1.9,
        max_seconds=600.0,
    ),
    "epsilon": Experiment(
        LOGISTIC,
        {
            "newton_120_30": newton(LOGISTIC, 1e-4, 120, 30),
            "newton_60_100": newton(LOGISTIC, 1e-4, 60, 100),
            "dane_60_30": dane(1e-4, 60, 30, 10.0),
            "momentum_0.95": momentum(1e-4, 3000, 10.0, 0.95),
            "lbfgs_300": lbfgs(LOGISTIC, 1e-4, 500, 300),
        },
        sigma=1.3,
        max_seconds=600.0,
    ),
    "mnist": Experiment(
        LOGISTIC,
        {
            "newton_30_300": newton(LOGISTIC, 1e-8, 30, 300),
            "newton_300_30": newton(LOGISTIC, 1e-8, 300, 30),
            "dane_10_300": dane(1e-8, 10, 300, 10.0),
            "momentum_0.95": momentum(1e-8, 2000, 10.0, 0.95),
            "lbfgs_300": lbfgs(LOGISTIC, 1e-8, 1000, 300),
        },
        recode=(6.5, 2.5),
        classes=(4.0, 9.0),
        sigma=9.2,
        max_seconds=600.0,
    ),
    "ridge": Experiment(
        SQUARED, {"newton_60_100": newton(SQUARED, 1e-6, 60, 100)}, scale=True
    ),
    "ridge_fourier": Experiment(
        SQUARED,
        {
            "newton_200_10": newton(SQUARED, 1e-8, 200, 10),
            "newton_50_100": newton(SQUARED, 1e-8, 50, 100),
            "admm_40_100": admm(SQUARED, 1e-8, 40, 100),
            "admm_20_300": admm(SQUARED, 1e-8, 20, 300),
            "cg_500": cg(1e-8, 500),
            "lbfgs_100": lbfgs(SQUARED, 1e-8, 200, 100),
            "lbfgs_300": lbfgs(SQUARED, 1e-8, 200, 300),
        },
        sigma=0.5510948938923474,
        scale=True,
    ),
    "elastic_net": Experiment(
        LOGISTIC,
        {
            "prox_newton_30_10": prox_newton(1e-4, 1e-6, 30, 10),
            "fista_3000": fista(1e-4, 1e-6, 3000, 100.0),
        },
        recode=(1.5, 0.5),
        max_seconds=3000.0,
    ),
}


def prepare(
    spark: SparkSession, experiment: Experiment, train_path: str, test_path: str, d: int, m: int
) -> tuple[DataFrame, DataFrame]:
    """The two tables of an experiment; the test side uses the statistics of the train side.

    Files have no key, so shards and the order inside them follow from a hash of the row.
    """
    train, test = (read_libsvm(spark, p, d) for p in (train_path, test_path))
    if experiment.classes is not None:
        train, test = (keep_classes(t, "y", experiment.classes) for t in (train, test))
    if experiment.recode is not None:
        train, test = (recode_affine(t, *experiment.recode) for t in (train, test))
    if experiment.scale:
        stats = fit_max_abs(train, d)
        train, test = (apply_max_abs(t, stats) for t in (train, test))
    return assign_shards(train, m, ["y", "x"]), test


def run_experiment(
    spark: SparkSession,
    experiment: Experiment,
    train_path: str,
    test_path: str,
    *,
    d: int,
    m: int,
    features: int | None = None,
    only: tuple[str, ...] | None = None,
    **shared,
) -> tuple[DataFrame, DataFrame]:
    """Run the grid on one prepared table with held-out tracking.

    Returns the histories ``(run_id, iter, ...)`` and a summary ``(run_id, stopped,
    iterations, objective, test_error, nonzero)``.
    """
    if experiment.max_seconds is not None:
        shared.setdefault("max_seconds", experiment.max_seconds)
    train, test = prepare(spark, experiment, train_path, test_path, d, m)
    grid = {k: v for k, v in experiment.grid.items() if only is None or k in only}
    feature_map = None
    if experiment.sigma is not None and features is not None:
        feature_map = RandomFourier(width=d, size=features, sigma=experiment.sigma)
    with (
        TrainingSet(train, d=d, feature_map=feature_map) as ts,
        TrainingSet(test, d=d, feature_map=feature_map) as held_out,
    ):
        table, results = run_sweep(ts, grid, held_out=held_out, **shared)
    summary = [
        (
            run_id,
            r.stopped,
            len(r.history) - 1,
            r.objective,
            r.history[-1]["test_error"],
            float((abs(r.w) > 1e-10).mean()),
        )
        for run_id, r in results.items()
    ]
    schema = (
        "run_id STRING, stopped STRING, iterations INT, objective DOUBLE, "
        "test_error DOUBLE, nonzero DOUBLE"
    )
    return table, spark.createDataFrame(summary, schema)
