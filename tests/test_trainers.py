"""Trainers against an independent optimum, against each other, and their invariants."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators.features import RandomFourier
from fitkit.operators.losses import LOGISTIC, SQUARED, Penalty
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.admm import fit_admm
from fitkit.plans.dane import fit_dane
from fitkit.plans.gradient import fit_cg, fit_fista, fit_lbfgs, fit_momentum
from fitkit.plans.grouped import fit_groups
from fitkit.plans.local import average_models
from fitkit.plans.newton import fit_newton, fit_prox_newton

L1, L2 = 0.002, 0.02


@pytest.fixture(scope="module")
def emb(spark, sf):
    with TrainingSet(fx.emb(spark, sf)) as ts:
        yield ts


@pytest.fixture(scope="module")
def ridge(spark, sf):
    with TrainingSet(fx.ridge2(spark, sf)) as ts:
        yield ts


@pytest.fixture(scope="module")
def clicks(spark, sf):
    with TrainingSet(fx.event2(spark, sf)) as ts:
        yield ts


def ml_weights(df, l1, l2):
    data = df.select(F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("label"), array_to_vector("x").alias("features"))
    model = LogisticRegression(
        fitIntercept=False,
        standardization=False,
        regParam=l1 + l2,
        elasticNetParam=l1 / (l1 + l2),
        tol=1e-12,
        maxIter=500,
    ).fit(data)
    return model.coefficients.toArray()


@pytest.fixture(scope="module")
def smooth_optimum(spark, sf):
    return ml_weights(fx.emb(spark, sf), 0.0, L2)


@pytest.fixture(scope="module")
def sparse_optimum(spark, sf):
    return ml_weights(fx.emb(spark, sf), L1, L2)


SMOOTH = {
    "newton": lambda ts: fit_newton(ts, LOGISTIC, l2=L2, max_iter=12),
    "newton_free": lambda ts: fit_newton(ts, LOGISTIC, l2=L2, max_iter=12, hessian="free"),
    "lbfgs": lambda ts: fit_lbfgs(ts, LOGISTIC, l2=L2, max_iter=15),
    "momentum": lambda ts: fit_momentum(ts, LOGISTIC, l2=L2, max_iter=60, rate=4.0, momentum=0.5),
    "dane": lambda ts: fit_dane(
        ts, l2=L2, max_iter=15, inner=60, rate=1.0, line_search=True, start="average"
    ),
    "admm": lambda ts: fit_admm(ts, LOGISTIC, l2=L2, max_iter=20, inner=30, rate=1.0, rho=0.05),
}


@pytest.mark.parametrize("name", sorted(SMOOTH))
def test_logistic_trainers_reach_the_independent_optimum(emb, smooth_optimum, name):
    penalty = Penalty(l2=L2)
    best = emb.evaluate(smooth_optimum, LOGISTIC, penalty).objective
    fit = SMOOTH[name](emb)
    assert fit.objective - best < 1e-6
    assert np.abs(fit.w - smooth_optimum).max() < 5e-3


SPARSE = {
    "prox_newton": lambda ts: fit_prox_newton(ts, l1=L1, l2=L2, max_iter=15),
    "fista_smooth": lambda ts: fit_fista(ts, l1=L1, l2=L2, max_iter=60, lipschitz=0.3),
    "fista_prox": lambda ts: fit_fista(
        ts, l1=L1, l2=L2, max_iter=60, lipschitz=0.3, l2_in_prox=True
    ),
}


@pytest.mark.parametrize("name", sorted(SPARSE))
def test_elastic_net_trainers_reach_the_independent_optimum(emb, sparse_optimum, name):
    penalty = Penalty(l1=L1, l2=L2)
    best = emb.evaluate(sparse_optimum, LOGISTIC, penalty).objective
    fit = SPARSE[name](emb)
    assert fit.objective - best < 1e-6
    assert ((fit.w == 0.0) == (np.abs(sparse_optimum) < 1e-6)).mean() > 0.95


def normal_equations(ts, l2):
    w = np.eye(ts.d)
    gram = np.stack([ts.gram_apply(v) for v in w])
    return np.linalg.solve(gram / ts.n + l2 * w, ts.moments() / ts.n)


RIDGE = {
    "newton": lambda ts: fit_newton(ts, SQUARED, l2=L2, max_iter=6),
    "newton_free": lambda ts: fit_newton(ts, SQUARED, l2=L2, max_iter=6, hessian="free"),
    "cg": lambda ts: fit_cg(ts, l2=L2, max_iter=ts.d),
    "lbfgs": lambda ts: fit_lbfgs(ts, SQUARED, l2=L2, max_iter=12),
    "admm": lambda ts: fit_admm(ts, SQUARED, l2=L2, max_iter=25, inner=100, rho=0.1),
}


@pytest.mark.parametrize("name", sorted(RIDGE))
@pytest.mark.parametrize("engine", ["native", "blocks"])
def test_ridge_trainers_solve_the_normal_equations(spark, sf, name, engine):
    with TrainingSet(fx.ridge2(spark, sf), engine=engine) as ts:
        exact = normal_equations(ts, L2)
        fit = RIDGE[name](ts)
        best = ts.evaluate(exact, SQUARED, Penalty(l2=L2)).objective
        assert fit.objective - best < 1e-8
        assert np.abs(fit.w - exact).max() < 1e-3
        final = ts.evaluate(fit.w, SQUARED, Penalty(l2=L2))
        assert fit.history[-1]["objective"] == pytest.approx(final.objective, abs=1e-12)
        assert fit.history[-1]["train_error"] == pytest.approx(final.error, abs=1e-12)


def test_ridge_wide_matrix_and_free_agree(spark, sf):
    with TrainingSet(fx.emb(spark, sf)) as ts:
        a = fit_newton(ts, SQUARED, l2=0.1, max_iter=4, hessian="matrix")
        b = fit_newton(ts, SQUARED, l2=0.1, max_iter=4, hessian="free", inner=200)
        assert np.abs(a.w - b.w).max() < 1e-8


def test_engines_give_the_same_sums(spark, sf):
    w, p = np.array([0.4, -0.7]), np.array([-0.2, 0.5])
    etas, penalty = np.array([1.0, 0.25]), Penalty(l2=0.1, l1=0.01)
    for loss in (LOGISTIC, SQUARED):
        got = []
        for engine in ("native", "blocks"):
            with TrainingSet(fx.event2(spark, sf), engine=engine) as ts:
                e = ts.evaluate(w, loss, penalty)
                f, s, first = ts.line(w, p, etas, loss, penalty, slopes=True)
                stats = {r["shard"]: (r["s"], *r["stats"]) for r in ts.shard_stats(w, loss).collect()}
                flat = np.concatenate([np.array(stats[k]) for k in sorted(stats)])
                got.append(
                    np.concatenate(
                        [[e.objective, e.error], e.gradient, f, s, first.gradient, flat]
                    )
                )
        np.testing.assert_allclose(got[0], got[1], rtol=1e-9, atol=1e-10)


def test_line_matches_single_evaluations(clicks):
    w, p, penalty = np.array([0.4, -0.7]), np.array([-0.2, 0.5]), Penalty(l2=0.1)
    etas = np.array([1.0, 0.25, 0.0625])
    f, s, first = clicks.line(w, p, etas, LOGISTIC, penalty, slopes=True)
    singles = [clicks.evaluate(w - e * p, LOGISTIC, penalty) for e in etas]
    np.testing.assert_allclose(f, [e.objective for e in singles], atol=1e-12)
    np.testing.assert_allclose(s, [p @ e.gradient for e in singles], atol=1e-12)
    np.testing.assert_allclose(first.gradient, singles[0].gradient, atol=1e-12)


@pytest.mark.parametrize("loss", [LOGISTIC, SQUARED], ids=lambda v: v.name)
def test_gradient_matches_central_difference(clicks, loss):
    w, penalty, h = np.array([0.4, -0.7]), Penalty(l2=0.1), 1e-5
    g = clicks.evaluate(w, loss, penalty).gradient
    for j in range(2):
        e = np.zeros(2)
        e[j] = h
        up = clicks.evaluate(w + e, loss, penalty).objective
        down = clicks.evaluate(w - e, loss, penalty).objective
        assert g[j] == pytest.approx((up - down) / (2 * h), abs=1e-7)


def test_line_search_never_raises_the_objective(emb):
    for fit in (
        fit_newton(emb, LOGISTIC, l2=1e-4, max_iter=6),
        fit_lbfgs(emb, LOGISTIC, l2=1e-4, max_iter=6),
        fit_prox_newton(emb, l1=1e-3, l2=1e-4, max_iter=6),
    ):
        values = [h["objective"] for h in fit.history]
        assert all(b <= a + 1e-12 for a, b in zip(values, values[1:]))


def test_first_lbfgs_step_goes_downhill_at_full_length(emb):
    fit = fit_lbfgs(emb, LOGISTIC, l2=1e-2, max_iter=2)
    assert fit.history[0]["step"] == 1.0
    assert fit.history[1]["objective"] < fit.history[0]["objective"]


def test_one_shard_is_exact_newton(spark, sf):
    whole = fx.ridge2(spark, sf).withColumn("shard", F.lit(0))
    with TrainingSet(whole) as ts:
        fit = fit_newton(ts, SQUARED, l2=L2, max_iter=1, line_search=False)
        assert np.abs(fit.w - normal_equations(ts, L2)).max() < 1e-10


def test_repeated_fits_do_not_change_state(ridge):
    first = fit_admm(ridge, SQUARED, l2=L2, max_iter=3, inner=20, rho=0.1)
    again = fit_admm(ridge, SQUARED, l2=L2, max_iter=3, inner=20, rho=0.1)
    np.testing.assert_allclose(first.w, again.w, atol=1e-13)
    a = fit_newton(ridge, SQUARED, l2=L2, max_iter=2)
    b = fit_newton(ridge, SQUARED, l2=L2, max_iter=2)
    np.testing.assert_allclose(a.w, b.w, atol=1e-13)


def test_seeded_solvers_do_not_depend_on_layout(spark, sf):
    weights = []
    for partitions, block_bytes in ((1, 16 << 20), (7, 4096)):
        df = fx.event2(spark, sf).repartition(partitions)
        with TrainingSet(df, block_bytes=block_bytes) as ts:
            weights.append(fit_dane(ts, l2=0.01, max_iter=2, inner=2, rate=1.0, seed=3).w)
            weights.append(
                fit_admm(ts, LOGISTIC, l2=0.01, max_iter=2, inner=2, rate=1.0, rho=0.1, seed=3).w
            )
    np.testing.assert_allclose(weights[0], weights[2], atol=1e-9)
    np.testing.assert_allclose(weights[1], weights[3], atol=1e-9)


@pytest.mark.parametrize("loss", [LOGISTIC, SQUARED], ids=lambda v: v.name)
def test_admm_is_right_on_unequal_shards(spark, sf, loss):
    """One shard holds a twelfth of the rows and only small feature values."""
    df = fx.event2(spark, sf).withColumn("shard", (F.col("x")[1] < 0.1).cast("int"))
    with TrainingSet(df) as ts:
        target = fit_newton(ts, loss, l2=0.1, max_iter=20)
        fit = fit_admm(ts, loss, l2=0.1, max_iter=25, inner=20, rate=2.0, rho=0.1)
        assert np.abs(fit.w - target.w).max() < 1e-4


def test_warm_start_by_model_averaging(clicks):
    start = average_models(clicks, LOGISTIC, l2=0.1, inner=20, rate=2.0)
    cold = clicks.evaluate(np.zeros(2), LOGISTIC, Penalty(l2=0.1)).objective
    warm = fit_momentum(
        clicks, LOGISTIC, l2=0.1, max_iter=1, rate=2.0, start="average", inner=20
    )
    assert warm.history[0]["objective"] < cold
    np.testing.assert_allclose(warm.path[0], start)


def test_average_of_ridge_shards_by_rows_and_by_statistics(spark, sf):
    out = []
    for engine in ("native", "blocks"):
        with TrainingSet(fx.ridge2(spark, sf), engine=engine) as ts:
            out.append(average_models(ts, SQUARED, l2=0.1, inner=50))
    np.testing.assert_allclose(out[0], out[1], atol=1e-9)


def test_grouped_fit_is_the_closed_form_without_l1(spark, sf):
    df = fx.ridge2(spark, sf)
    with TrainingSet(df) as ts:
        got = {r["shard"]: (r["s"], np.array(r["w"])) for r in fit_groups(ts, lam=0.05).collect()}
    rows = df.toPandas()
    assert sum(s for s, _ in got.values()) == len(rows)
    for shard, part in rows.groupby("shard"):
        x, y = np.stack(part["x"]), part["y"].to_numpy()
        exact = np.linalg.solve(x.T @ x / len(y) + 0.05 * np.eye(2), x.T @ y / len(y))
        np.testing.assert_allclose(got[shard][1], exact, atol=1e-9)


def test_grouped_fit_by_rows_equals_the_fit_by_statistics(spark, sf):
    out = []
    for limit in (2048, 1):
        with TrainingSet(fx.emb(spark, sf), gram_limit=limit) as ts:
            tilt = np.linspace(-1, 1, 64)
            fits = fit_groups(ts, lam=0.05, sigma=0.1, tilt=tilt).orderBy("shard").collect()
            out.append(fits)
    for a, b in zip(*out, strict=True):
        assert (a["shard"], a["s"]) == (b["shard"], b["s"])
        np.testing.assert_allclose(a["w"], b["w"], atol=1e-8)
        assert a["objective"] == pytest.approx(b["objective"], abs=1e-10)


def test_held_out_error_has_its_own_column(spark, sf):
    df = fx.event2(spark, sf)
    train, test = df.filter("id % 5 <> 0"), df.filter("id % 5 = 0")
    with TrainingSet(train) as ts, TrainingSet(test) as held_out:
        fit = fit_newton(ts, LOGISTIC, l2=0.01, max_iter=2, held_out=held_out)
    rows = fit.history_df().collect()
    assert all(r["test_error"] is not None and 0 <= r["test_error"] <= 1 for r in rows)
    assert [r["iter"] for r in rows] == [0, 1, 2]
    assert fit.weights_df().count() == 2


def test_stop_rules(clicks):
    from fitkit.plans.steps import StopRule

    fit = fit_newton(clicks, LOGISTIC, l2=0.1, max_iter=50)
    assert fit.stopped == "converged" and len(fit.history) < 20
    slow = fit_momentum(
        clicks, LOGISTIC, l2=0.1, max_iter=50, rate=0.1, stop=StopRule(max_seconds=0.0)
    )
    assert slow.stopped == "time" and len(slow.history) == 1
    wild = fit_momentum(clicks, SQUARED, l2=0.1, max_iter=50, rate=1e6)
    assert wild.stopped == "diverged"


def test_random_features_are_mapped_while_packing(spark, sf):
    m = RandomFourier(width=64, size=96, sigma=1.5)
    with TrainingSet(fx.emb(spark, sf), feature_map=m) as ts:
        assert ts.d == 96
        fit = fit_newton(ts, LOGISTIC, l2=1e-3, max_iter=8)
        assert fit.history[-1]["grad_norm_sq"] < 1e-10
        assert fit.history[-1]["train_error"] < fit.history[0]["train_error"]
