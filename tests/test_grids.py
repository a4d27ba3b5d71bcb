"""Grids over shared passes, group fits with a duality gap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators.losses import LOGISTIC, SQUARED, Penalty
from fitkit.operators.training_set import TrainingSet
from fitkit.plans import batched
from fitkit.plans.dane import fit_dane
from fitkit.plans.grouped_dual import dual_ascent, fit_groups_dual
from fitkit.plans.gradient import fit_cg, fit_fista, fit_lbfgs, fit_momentum, two_loop
from fitkit.plans.newton import fit_newton
from fitkit.plans.sweep import run_sweep
from fitkit.plans.vector_free import combine, fit_lbfgs_vector_free

L2 = 0.05
GRID = {
    "momentum": lambda ts: fit_momentum(ts, LOGISTIC, l2=L2, max_iter=4, rate=2.0, momentum=0.6),
    "lbfgs": lambda ts: fit_lbfgs(ts, LOGISTIC, l2=L2, max_iter=6),
    "lbfgs ridge": lambda ts: fit_lbfgs(ts, SQUARED, l2=L2, max_iter=5),
    "fista": lambda ts: fit_fista(ts, l1=0.002, l2=L2, max_iter=5, lipschitz=2.0),
    "cg": lambda ts: fit_cg(ts, l2=L2, max_iter=7),
    "short": lambda ts: fit_momentum(ts, SQUARED, l2=1.0, max_iter=1, rate=0.1),
}


def test_members_equal_single_runs_and_share_passes(spark, sf):
    with TrainingSet(fx.emb(spark, sf)) as ts:
        single = {k: fit(ts) for k, fit in GRID.items()}
        got, passes = batched.run_batched(ts, GRID)
        alone = [batched.run_batched(ts, {k: fit})[1] for k, fit in GRID.items()]
        table, _ = run_sweep(ts, GRID, batched=True)
        assert table.select("run_id").distinct().count() == len(GRID)
    assert list(got) == list(GRID)
    for k, want in single.items():
        assert np.allclose(got[k].w, want.w, rtol=0, atol=1e-8), k
        assert got[k].stopped == want.stopped and len(got[k].history) == len(want.history)
    assert passes == max(alone) < sum(alone)


def test_sums_of_a_shared_pass(spark, sf):
    w, p, etas = np.array([0.3, -0.2]), np.array([0.1, 0.4]), np.array([1.0, 0.25])
    with TrainingSet(fx.logit2(spark, sf)) as ts:
        penalty = Penalty(l2=L2)
        asks = [
            batched.ask_points([w, p], ts.n, LOGISTIC, penalty),
            batched.ask_line(w, p, etas, ts.n, LOGISTIC, penalty, True),
            batched.ask_line(w, p, etas, ts.n, SQUARED, penalty, False),
        ]
        points, line, squared = batched.answer_all(ts, asks)
        for got, want in zip(points, ts.evaluate_all([w, p], LOGISTIC, penalty)):
            assert got.error == want.error and np.allclose(got.gradient, want.gradient, atol=1e-12)
        for got, loss, slopes in ((line, LOGISTIC, True), (squared, SQUARED, False)):
            want = ts.line(w, p, etas, loss, penalty, slopes=slopes)
            assert np.allclose(got[0], want[0], atol=1e-12)
            assert (got[1] is None) == (want[1] is None) or np.allclose(got[1], want[1])
            assert np.allclose(got[2].gradient, want[2].gradient, atol=1e-12)


def test_a_member_that_fails_ends_the_grid(spark, sf):
    with TrainingSet(fx.event2(spark, sf)) as ts:
        runs = {"good": GRID["momentum"], "shards": lambda s: fit_newton(s, LOGISTIC, l2=L2, max_iter=1)}
        with pytest.raises(AttributeError):
            batched.run_batched(ts, runs)


# --- dual ascent ---------------------------------------------------------------------------


def group(seed, s, d, scale=1.0):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(s, d)) * scale
    return x, x @ draw.normal(size=d) * 0.3 + draw.normal(size=s)


@pytest.mark.parametrize("s,d,lam,scale", [(50, 8, 0.1, 1.0), (400, 20, 1e-3, 1.0), (300, 40, 1e-5, 3.0), (1, 3, 0.5, 1.0), (30, 90, 0.01, 1.0)])
@pytest.mark.parametrize("sigma", [0.0, 0.7])
def test_gap_certifies_the_optimum(s, d, lam, scale, sigma):
    x, y = group(s, s, d, scale)
    tilt = np.linspace(-0.2, 0.3, d)
    w, value, gap, taken = dual_ascent(x, y, lam=lam, sigma=sigma, tilt=tilt, tol=1e-10, epochs=3000)
    assert 0 <= gap <= 1e-10 and taken < 3000
    slope = x.T @ (x @ w - y) / s + lam * (w - tilt)
    sub = np.where(w != 0, slope + lam * sigma * np.sign(w), np.maximum(np.abs(slope) - lam * sigma, 0))
    assert np.abs(sub).max() < 1e-4
    if sigma == 0:
        exact = np.linalg.solve(x.T @ x / s + lam * np.eye(d), x.T @ y / s + lam * tilt)
        assert np.allclose(w, exact, atol=2 * np.sqrt(2e-10 / lam) + 1e-9)


def test_gap_is_never_below_the_distance_to_the_optimum():
    x, y = group(9, 200, 30, 2.0)
    options = dict(lam=1e-4, sigma=0.3, tilt=np.zeros(30), seed=1)
    best = dual_ascent(x, y, tol=1e-13, epochs=5000, **options)[1]
    for epochs in (1, 2, 5, 10, 30):
        _, value, gap, _ = dual_ascent(x, y, tol=0.0, epochs=epochs, **options)
        assert gap >= value - best - 1e-12


def test_keys_of_any_type_and_large_groups(spark):
    rows = []
    for name, s in (("one", 1), ("small", 40), (None, 25), ("large", 900)):
        x, y = group(len(rows), s, 4)
        rows += [(name, float(b), a.tolist()) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "name string, y double, x array<double>").repartition(5)
    options = dict(lam=0.05, sigma=0.4, tilt=np.array([0.1, 0.0, -0.3, 0.2]))
    want = {r["key"]: r for r in fit_groups_dual(df, "name", **options).collect()}
    got = {r["key"]: r for r in fit_groups_dual(df, "name", group_bytes=8 * 4 * 30, **options).collect()}
    assert set(got) == set(want) == {"one", "small", None, "large"}
    for k, r in want.items():
        assert r["gap"] < 1e-9 and got[k]["gap"] < 1e-9 and r["s"] == got[k]["s"]
        assert np.allclose(r["w"], got[k]["w"], atol=1e-4) and abs(r["objective"] - got[k]["objective"]) < 2e-9
    assert got["large"]["epochs"] is None and got["one"]["epochs"] > 0
    assert fit_groups_dual(df.limit(0), "name", **options).count() == 0
    dated = df.filter("name = 'small'").select(F.to_date(F.lit("2020-02-29")).alias("name"), "y", "x")
    assert str(fit_groups_dual(dated, "name", **options).first()["key"]) == "2020-02-29"


# --- held-out errors and packed shards ------------------------------------------------------


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


TRACKED = {
    "newton": lambda ts, **k: fit_newton(ts, LOGISTIC, l2=L2, max_iter=3, **k),
    "lbfgs": lambda ts, **k: fit_lbfgs(ts, LOGISTIC, l2=L2, max_iter=4, **k),
    "lbfgs ridge": lambda ts, **k: fit_lbfgs(ts, SQUARED, l2=L2, max_iter=3, **k),
    "dane": lambda ts, **k: fit_dane(ts, l2=L2, max_iter=2, inner=2, rate=0.5, **k),
    "fista": lambda ts, **k: fit_fista(ts, l1=0.002, l2=L2, max_iter=3, lipschitz=2.0, **k),
}


@pytest.mark.parametrize("name", sorted(TRACKED))
def test_held_out_errors_cost_no_job(spark, sf, name):
    rows = fx.emb(spark, sf)
    train, test = rows.filter("id % 5 > 0"), rows.filter("id % 5 = 0")
    with TrainingSet(train) as ts, TrainingSet(test) as held:
        TRACKED[name](ts)  # fills the caches
        held.blocks  # noqa: B018
        plain, few = jobs_of(spark, f"plain {name}", lambda: TRACKED[name](ts))
        got, as_many = jobs_of(spark, f"tracked {name}", lambda: TRACKED[name](ts, held_out=held))
        loss = SQUARED if "ridge" in name else LOGISTIC
        want = [held.mean_error(w, loss) for w in got.path]
        assert ts._tracked is None
    assert np.allclose(got.w, plain.w, rtol=0, atol=1e-12)
    assert np.allclose([h["test_error"] for h in got.history], want, rtol=1e-12, atol=1e-12)
    assert as_many == few


def test_many_small_shards_share_tasks(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(20_000, 2))
    y = np.where(draw.random(20_000) < 0.5, 1.0, -1.0)
    rows = spark.createDataFrame(
        [(k, k % 9973, float(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y))],
        "id long, shard int, y double, x array<double>",
    ).repartition(8)
    with TrainingSet(rows) as ts:
        fit = fit_newton(ts, LOGISTIC, l2=1.0, max_iter=1, inner=2, hessian="free")
        assert ts.m == 9973 and ts.gathered.rdd.getNumPartitions() == ts.gather_tasks <= 64
    g = -0.5 * (y @ x) / 20_000
    want = np.zeros(2)
    for shard in range(9973):
        at = np.arange(shard, 20_000, 9973)
        h = 0.25 * x[at].T @ x[at] / len(at) + np.eye(2)
        want += len(at) * np.linalg.solve(h, g) / 20_000
    assert np.allclose(fit.path[0] - fit.path[1], want * fit.history[0]["step"], atol=1e-9)


# --- vector-free L-BFGS --------------------------------------------------------------------


def test_coefficients_equal_the_two_loops():
    draw = np.random.default_rng(4)
    s, y, g = draw.normal(size=(5, 30)), draw.normal(size=(5, 30)), draw.normal(size=30)
    y += 3 * s
    b = np.concatenate([s, y, g[None]])
    want = two_loop(g, [(a, c, float(a @ c)) for a, c in zip(s, y)])
    assert np.allclose(combine(b @ b.T) @ b, want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("memory,chunk", [(2, 7), (10, 64), (10, 1 << 16)])
def test_vector_free_equals_lbfgs(spark, sf, memory, chunk):
    with TrainingSet(fx.emb(spark, sf)) as ts:
        options = dict(l2=L2, max_iter=6, memory=memory)
        want = fit_lbfgs(ts, LOGISTIC, **options)
        got = fit_lbfgs_vector_free(ts, LOGISTIC, chunk=chunk, **options)
    assert np.allclose(got.w, want.w, rtol=0, atol=1e-9) and not got.path
    assert len(got.history) == len(want.history) == 7
