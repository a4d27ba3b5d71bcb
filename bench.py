"""Headline fits at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import fixtures as fx  # noqa: E402
from fitkit.operators.features import RandomFourier, bandwidth  # noqa: E402
from fitkit.operators.losses import LOGISTIC, SQUARED  # noqa: E402
from fitkit.operators.prepare import apply_max_abs, fit_max_abs, replicate_noise  # noqa: E402
from fitkit.operators.training_set import TrainingSet  # noqa: E402
from fitkit.plans.admm import fit_admm  # noqa: E402
from fitkit.plans.dane import fit_dane  # noqa: E402
from fitkit.plans.gradient import fit_cg, fit_fista, fit_lbfgs, fit_momentum  # noqa: E402
from fitkit.plans.grouped import fit_groups  # noqa: E402
from fitkit.plans.local import average_models  # noqa: E402
from fitkit.plans.newton import fit_newton, fit_prox_newton  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
GAP = 1e-6


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("fitkit-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def jobs_run(spark: SparkSession) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def fourier(spark, source: str):
    """A logistic table and the random features it is fitted on."""
    df = fx.emb(spark, SF_DIR) if source == "embeddings" else fx.ridge3(spark, SF_DIR)
    if source == "lineitem":
        df = fx.logit2(spark, SF_DIR)
    width = 64 if source == "embeddings" else 2
    sigma = bandwidth(df, width).first()["sigma"]
    size = 512 if source == "embeddings" else 64
    return df, RandomFourier(width=width, size=size, sigma=sigma)


def training_fits():
    """``name -> (fixture, fit)``; every fit returns a result with a history."""
    return {
        "newton_ridge": (fx.ridge2, lambda ts: fit_newton(ts, SQUARED, l2=1e-2, max_iter=5)),
        "newton_logistic": (fx.logit2, lambda ts: fit_newton(ts, LOGISTIC, l2=1e-2, max_iter=5)),
        "prox_newton": (
            fx.logit2,
            lambda ts: fit_prox_newton(ts, l1=1e-3, l2=1e-2, max_iter=5),
        ),
        "lbfgs_logistic": (fx.logit2, lambda ts: fit_lbfgs(ts, LOGISTIC, l2=1e-2, max_iter=10)),
        "lbfgs_ridge": (fx.ridge3, lambda ts: fit_lbfgs(ts, SQUARED, l2=1e-2, max_iter=10)),
        "cg_ridge": (fx.ridge3, lambda ts: fit_cg(ts, l2=1e-2, max_iter=5)),
        "momentum_logistic": (
            fx.logit2,
            lambda ts: fit_momentum(ts, LOGISTIC, l2=1e-2, max_iter=20, rate=2.0, momentum=0.7),
        ),
        "fista_logistic": (
            fx.logit2,
            lambda ts: fit_fista(ts, l1=1e-3, l2=1e-2, max_iter=20, lipschitz=0.3),
        ),
        "admm_ridge": (
            fx.ridge2,
            lambda ts: fit_admm(ts, SQUARED, l2=1e-2, max_iter=8, inner=20, rho=0.1),
        ),
        "dane_logistic": (
            fx.event2,
            lambda ts: fit_dane(ts, l2=1e-2, max_iter=5, inner=10, rate=2.0),
        ),
        "admm_logistic": (
            fx.event2,
            lambda ts: fit_admm(ts, LOGISTIC, l2=1e-2, max_iter=8, inner=10, rate=2.0, rho=0.05),
        ),
    }


def reached(history: list[dict]) -> int | None:
    """Iterations until the objective is within a relative 1e-6 of the best one seen."""
    best = min(h["objective"] for h in history)
    return next(
        (h["iter"] for h in history if h["objective"] - best <= GAP * max(abs(best), 1e-12)), None
    )


def main() -> None:
    spark = session()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM side
    seconds: dict[str, float] = {}
    detail: dict[str, dict] = {}

    def timed(name, body):
        before, jobs = time.perf_counter(), jobs_run(spark)
        history = body()
        seconds[name] = round(time.perf_counter() - before, 3)
        info = {"jobs": jobs_run(spark) - jobs}
        if history:
            iters = len(history) - 1
            info |= {
                "iterations": iters,
                "sec_per_iter": round(history[-1]["seconds"] / max(1, iters), 3),
                "iters_to_gap": reached(history),
            }
        detail[name] = info

    def fit(fixture, run):
        with TrainingSet(fixture(spark, SF_DIR)) as ts:
            return run(ts).history

    for name, (fixture, run) in training_fits().items():
        timed(name, lambda: fit(fixture, run))

    def fourier_fit(source, run):
        df, feature_map = fourier(spark, source)
        with TrainingSet(df, feature_map=feature_map) as ts:
            return run(ts).history

    for source in ("lineitem", "embeddings"):
        timed(
            f"newton_logistic_fourier_{source}",
            lambda: fourier_fit(
                source, lambda ts: fit_newton(ts, LOGISTIC, l2=1e-4, max_iter=5, inner=30)
            ),
        )

    def average():
        with TrainingSet(fx.ridge3(spark, SF_DIR)) as ts:
            average_models(ts, SQUARED, l2=1e-2)

    def groups():
        with TrainingSet(fx.ridge3(spark, SF_DIR)) as ts:
            fit_groups(ts, lam=0.05, sigma=0.5).collect()

    def prepare():
        df = fx.event2(spark, SF_DIR)
        noisy = replicate_noise(df, 5, 0.02, seed=5)
        scaled = apply_max_abs(noisy, fit_max_abs(df, 2))
        scaled.write.format("noop").mode("overwrite").save()

    def wide(run):
        """Embeddings under 4,096 random features."""
        df, _ = fourier(spark, "embeddings")
        sigma = bandwidth(df, 64).first()["sigma"]
        with TrainingSet(df, feature_map=RandomFourier(width=64, size=4096, sigma=sigma)) as ts:
            return run(ts)

    def tiles(ts):
        ts.shard_tiles(np.zeros(ts.d), SQUARED).write.format("noop").mode("overwrite").save()

    def lockstep(ts):
        return fit_newton(ts, LOGISTIC, l2=1e-4, max_iter=2, inner=10, hessian="lockstep").history

    timed("model_average_ridge", average)
    timed("grouped_enet_ls", groups)
    timed("prepare_scale_noise", prepare)
    total = round(sum(seconds.values()), 3)  # of what all rounds have measured
    timed("newton_lockstep_embeddings_4096", lambda: wide(lockstep))
    timed("gram_tiled_embeddings_4096", lambda: wide(tiles))

    print(
        json.dumps(
            {
                "metric": "total fit and preparation time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name,
                "detail": detail,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
