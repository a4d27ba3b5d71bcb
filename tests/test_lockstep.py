"""Shards that no task holds: lockstep solves and tiled matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators import lockstep
from fitkit.operators.losses import LOGISTIC, SQUARED, shrink
from fitkit.operators.shards import conjugate_gradient, elastic_net_quadratic, split_stats
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.newton import fit_newton, fit_prox_newton

L2 = 0.02


def driven(solver, a):
    passes = 0
    while (z := solver.ask()) is not None:
        solver.tell(a @ z)
        passes += 1
    return solver.answer(), passes


def system(seed, d=30):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(80, d)) * draw.uniform(0.2, 2.0, d)
    return x.T @ x / 80 + 0.01 * np.eye(d), draw.normal(size=d), draw.normal(size=d) * (draw.random(d) < 0.5)


@pytest.mark.parametrize("steps", [3, 100])
def test_cg_takes_the_same_steps(steps):
    a, b, _ = system(0)
    got, passes = driven(lockstep.ConjugateGradient(b, steps), a)
    assert np.allclose(got, conjugate_gradient(lambda p: a @ p, b, steps), rtol=0, atol=1e-12)
    assert passes <= steps


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("l1", [0.0, 0.05, 0.5, 50.0])
def test_active_sets_reach_the_minimum(seed, l1):
    a, g, w = system(seed)
    got, passes = driven(lockstep.ElasticNet(w, g, l1, 600), a)
    want = elastic_net_quadratic(a, a @ w - g, l1, start=w, sweeps=20_000)
    assert np.allclose(w - got, want, rtol=0, atol=1e-9)
    assert ((w - got == 0) == (want == 0)).all()
    assert passes < 600


def test_active_sets_at_the_minimum_ask_nothing():
    solver = lockstep.ElasticNet(np.zeros(3), np.array([0.1, -0.1, 0.0]), 0.2, 10)
    assert solver.ask() is None and not solver.answer().any()


@pytest.fixture(scope="module")
def rows(spark, sf):
    return fx.emb(spark, sf).repartition(7).cache()


def test_lockstep_equals_gathered_shards(rows):
    with TrainingSet(rows) as one, TrainingSet(rows) as two:
        want = fit_newton(one, LOGISTIC, l2=L2, max_iter=3, inner=12, hessian="free")
        got = fit_newton(two, LOGISTIC, l2=L2, max_iter=3, inner=12, hessian="lockstep")
        assert "gathered" not in two.__dict__
    assert np.allclose(got.w, want.w, rtol=0, atol=1e-9)
    assert np.allclose([h["objective"] for h in got.history], [h["objective"] for h in want.history], atol=1e-12)


def test_a_shard_beyond_a_task_is_solved_not_refused(rows):
    hot = rows.withColumn("shard", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5 + 1).cast("int"))
    with TrainingSet(hot) as one, TrainingSet(hot, shard_bytes=30_000, gram_limit=8) as two:
        want = fit_newton(one, LOGISTIC, l2=L2, max_iter=2, inner=10, hessian="free")
        got = fit_newton(two, LOGISTIC, l2=L2, max_iter=2, inner=10)
        assert two.has_oversized_shard and "gathered" not in two.__dict__
        assert np.allclose(got.w, want.w, rtol=0, atol=1e-9)


def test_proximal_lockstep(rows):
    options = dict(l1=0.005, l2=L2, max_iter=3, inner=400)
    with TrainingSet(rows) as one, TrainingSet(rows) as two:
        want = fit_prox_newton(one, **options)
        got = fit_prox_newton(two, lockstep_solves=True, **options)
    assert np.allclose(got.w, want.w, rtol=0, atol=1e-7)
    assert ((got.w == 0) == (want.w == 0)).all()


def test_shards_take_turns_when_their_vectors_weigh_too_much(rows, monkeypatch):
    with TrainingSet(rows) as ts:
        want = fit_newton(ts, LOGISTIC, l2=L2, max_iter=1, inner=4, hessian="lockstep")
        monkeypatch.setattr(lockstep, "ASK_BYTES", 64 * 8)
        monkeypatch.setattr(lockstep, "HOLD_BYTES", 64 * 8)
        got = fit_newton(ts, LOGISTIC, l2=L2, max_iter=1, inner=4, hessian="lockstep")
    assert np.allclose(got.w, want.w, rtol=0, atol=1e-12)


@pytest.mark.parametrize("tile,hold", [(64, 1 << 27), (20, 1 << 27), (7, 5000)])
def test_tiles_hold_the_matrices(rows, monkeypatch, tile, hold):
    monkeypatch.setattr(lockstep, "HOLD_BYTES", hold)
    w = np.linspace(-0.3, 0.3, 64)
    with TrainingSet(rows) as ts:
        want = {r["shard"]: split_stats(np.array(r["stats"]), 64)[0] for r in ts.shard_stats(w, LOGISTIC).collect()}
        tiles = ts.shard_tiles(w, LOGISTIC, tile).collect()
        sizes = {r["shard"]: r["s"] for r in ts.shard_sizes().collect()}
    side = -(-64 // tile)
    assert len(tiles) == len(want) * side * (side + 1) // 2
    for t in tiles:
        a, b = slice(t["i"] * tile, (t["i"] + 1) * tile), slice(t["j"] * tile, (t["j"] + 1) * tile)
        m = want[t["shard"]][a, b]
        assert np.allclose(np.frombuffer(t["tile"]).reshape(m.shape), m, rtol=1e-12, atol=1e-12)
        assert t["s"] == sizes[t["shard"]]


def test_ridge_above_the_gram_limit_uses_tiles(rows):
    options = dict(l2=L2, max_iter=2, inner=10)
    with TrainingSet(rows) as one, TrainingSet(rows, gram_limit=16) as two:
        want = fit_newton(one, SQUARED, hessian="free", **options)
        got = fit_newton(two, SQUARED, hessian="matrix", tile=10, **options)
    assert np.allclose(got.w, want.w, rtol=0, atol=1e-9)


def test_one_row_and_empty_questions(spark):
    one = spark.createDataFrame([(0, 0, 1.0, [1.0, 2.0]), (1, 3, -1.0, [2.0, 0.0])], "id long, shard int, y double, x array<double>")
    with TrainingSet(one) as ts:
        fit = fit_newton(ts, LOGISTIC, l2=1.0, max_iter=2, hessian="lockstep")
        assert np.isfinite(fit.w).all()
        prox = fit_prox_newton(ts, l1=10.0, l2=1.0, max_iter=2, lockstep_solves=True)
        assert not prox.w.any()
    assert shrink(0.5, 1.0) == 0.0
