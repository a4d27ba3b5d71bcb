"""Edge cases: shards, labels, numerics, sources, steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators import prepare, score
from fitkit.operators.blocks import Block, fold_partials, partial_batch
from fitkit.operators.features import (
    RandomFourier,
    bandwidth,
    random_fourier,
    random_fourier_native,
)
from fitkit.operators.losses import LOGISTIC, SQUARED, Penalty, shrink
from fitkit.operators.shards import (
    conjugate_gradient,
    elastic_net_quadratic,
    elastic_net_rows,
    svrg,
)
from fitkit.operators.training_set import TrainingSet
from fitkit.plans import local
from fitkit.plans.admm import fit_admm
from fitkit.plans.dane import fit_dane
from fitkit.plans.gradient import fit_cg
from fitkit.plans.newton import fit_newton
from fitkit.plans.steps import armijo, wolfe
from fitkit.session import checkpoint_dir, scratch_path
from fitkit.sources import parse_libsvm_text, read_libsvm, read_text, relayout, write_libsvm


def small(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, shard INT, y DOUBLE, x ARRAY<DOUBLE>")


def numbers(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    y = np.where(x @ np.ones(d) + rng.standard_normal(n) > 0, 1.0, -1.0)
    return x, y


def table_of(spark, x, y, shard):
    return small(
        spark, [(i, int(s), float(b), a.tolist()) for i, (a, b, s) in enumerate(zip(x, y, shard))]
    )


# ---- shards ------------------------------------------------------------------------


def test_tiny_one_class_and_uneven_shards(spark):
    x, y = numbers(200, 3)
    shard = np.where(np.arange(200) < 3, 7, np.where(y > 0, 0, 1))  # 3 rows; one class each
    with TrainingSet(table_of(spark, x, y, shard)) as ts:
        assert ts.m == 3
        newton = fit_newton(ts, LOGISTIC, l2=1.0, max_iter=30)
        dane = fit_dane(ts, l2=1.0, max_iter=3, inner=3, rate=0.2)
        assert newton.history[-1]["grad_norm_sq"] < 1e-6
        assert dane.objective < dane.history[0]["objective"]


def test_oversized_shard_is_split_and_no_row_is_lost(spark):
    """A shard with most of the rows; the budget allows 100 rows per task."""
    x, y = numbers(3000, 4)
    shard = np.where(np.arange(3000) % 10 == 0, 1, 0)
    df = table_of(spark, x, y, shard)
    with TrainingSet(df, shard_bytes=100 * 32, gram_limit=1, split_shards=True) as ts:
        assert ts.has_oversized_shard and ts.n_slots == 27 + 3
        sizes = ts.gathered.groupBy("shard").agg(F.sum("s").alias("s")).collect()
        assert len(sizes) == 30 and sum(r["s"] for r in sizes) == 3000
        assert max(r["s"] for r in sizes) < 200
        # One slot per partition: that is what the labels are for.
        per = ts.gathered.select(F.spark_partition_id().alias("p"), "shard").distinct()
        assert per.groupBy("p").count().agg(F.max("count")).first()[0] == 1
        fit = fit_newton(ts, LOGISTIC, l2=0.1, max_iter=8)
    with TrainingSet(df) as ts:
        whole = fit_newton(ts, LOGISTIC, l2=0.1, max_iter=8)
    np.testing.assert_allclose(fit.w, whole.w, atol=1e-4)


def test_models_do_not_depend_on_the_task_budget(spark, monkeypatch):
    """Every budget gives the same model; what needs the rows of a large shard reads them where they lie."""
    x, y = numbers(3000, 4)
    shard = np.where(np.arange(3000) % 10 == 0, 1, 0)
    df = table_of(spark, x, y, shard)
    fits = []
    for limit in (100 * 32, 1000 * 32, 1 << 28):
        with TrainingSet(df, shard_bytes=limit) as ts:
            fits.append(fit_newton(ts, LOGISTIC, l2=0.1, max_iter=2).w)
            assert ("gathered" in ts.__dict__) == (limit == 1 << 28)
    monkeypatch.setattr(local, "GATHER_BYTES", 0)  # as if the table were large
    with TrainingSet(df) as ts:
        fits.append(fit_newton(ts, LOGISTIC, l2=0.1, max_iter=2).w)
        assert "gathered" not in ts.__dict__
    with TrainingSet(df) as ts:
        fits.append(fit_newton(ts, LOGISTIC, l2=0.1, max_iter=2, hessian="free").w)
        assert "gathered" in ts.__dict__ and "pure_blocks" not in ts.__dict__
    for w in fits[1:]:
        np.testing.assert_allclose(fits[0], w, atol=1e-10)
    with TrainingSet(df, shard_bytes=100 * 32) as ts, TrainingSet(df) as roomy:
        # No task may hold a shard: solvers that need its rows go where they lie.
        with pytest.raises(ValueError, match="use about 54 shards"):
            ts.gathered  # noqa: B018
        free = fit_newton(ts, LOGISTIC, l2=0.1, max_iter=2, hessian="free")
        np.testing.assert_allclose(free.w, fits[0], atol=1e-9)
        for fit in (
            lambda s, **k: fit_dane(s, l2=1.0, max_iter=1, inner=1, rate=0.1, **k),
            lambda s, **k: fit_admm(s, LOGISTIC, l2=1.0, max_iter=1, inner=1, **k),
            lambda s, **k: fit_dane(s, l2=1.0, max_iter=1, inner=1, rate=0.1, start="average", **k),
        ):
            np.testing.assert_allclose(fit(ts).w, fit(roomy, streamed=True).w, atol=1e-12)
        assert "gathered" not in ts.__dict__


def test_copies_without_ids_are_reported_not_hidden(spark):
    df = spark.createDataFrame(
        [(0, 1.0, [1.0, 2.0])] * 500 + [(0, -1.0, [0.5, 1.0])] * 500,
        "shard INT, y DOUBLE, x ARRAY<DOUBLE>",
    )
    oversized = TrainingSet(df, shard_bytes=100 * 16, split_shards=True)
    with oversized as ts, pytest.raises(ValueError, match="unique ids"):
        ts.gathered


def test_salted_merge_of_statistics(spark):
    from fitkit.operators.shards import merged_stats

    x, y = numbers(500, 3)
    df = table_of(spark, x, y, np.arange(500) % 3)
    with TrainingSet(df) as ts:
        w = np.array([0.1, -0.2, 0.3])
        plain = merged_stats(ts.pure_blocks, ts.shape, 1, w, LOGISTIC).collect()
        salted = merged_stats(ts.pure_blocks, ts.shape, 400, w, LOGISTIC).collect()
    key = lambda r: r["shard"]
    for a, b in zip(sorted(plain, key=key), sorted(salted, key=key), strict=True):
        assert (a["shard"], a["s"]) == (b["shard"], b["s"])
        np.testing.assert_allclose(a["stats"], b["stats"], atol=1e-10)


def test_uneven_input_is_spread(spark, sf):
    one = fx.ridge2(spark, sf).coalesce(1)
    with TrainingSet(one) as ts:
        ts.prepare(SQUARED)
        used = ts.flat.groupBy(F.spark_partition_id().alias("p")).count().count()
        assert used == spark.sparkContext.defaultParallelism
        assert ts.n == 60_000


def test_many_partials_are_merged_before_the_driver(spark):
    def kernel(batches):
        for _ in batches:
            pass
        yield partial_batch(np.arange(5.0))

    partials = spark.range(0, 40, 1, 40).mapInArrow(kernel, "part INT, v BINARY")
    for tasks in (40, None):
        np.testing.assert_allclose(fold_partials(partials, np.add, 5, tasks), 40 * np.arange(5.0))


# ---- labels and shapes ---------------------------------------------------------------


def test_labels_are_checked_over_the_whole_table(spark):
    x, _ = numbers(20, 2)
    for y, text in ((np.arange(20.0), "not -1 or"), (np.ones(20), "all labels are equal")):
        with TrainingSet(table_of(spark, x, y, np.zeros(20))) as ts:
            with pytest.raises(ValueError, match=text):
                fit_newton(ts, LOGISTIC, l2=0.1, max_iter=1)


def test_mixed_widths_are_an_error(spark):
    df = small(spark, [(0, 0, 1.0, [1.0, 2.0]), (1, 0, -1.0, [1.0, 2.0, 3.0])])
    with TrainingSet(df, engine="native") as ts, pytest.raises(Exception, match="width"):
        ts.prepare(SQUARED)
    null = small(spark, [(0, 0, 1.0, [1.0, None]), (1, 0, -1.0, [1.0, 2.0])])
    for engine in ("native", "blocks"):
        with TrainingSet(null, engine=engine) as ts, pytest.raises(Exception, match="null"):
            ts.shard_stats(np.zeros(2), SQUARED).collect()
    with TrainingSet(df, engine="blocks") as ts, pytest.raises(Exception, match="width"):
        ts.prepare(LOGISTIC)


# ---- numerics --------------------------------------------------------------------------


@pytest.mark.parametrize("engine", ["native", "blocks"])
def test_extreme_margins_stay_finite(spark, engine):
    df = small(spark, [(0, 0, 1.0, [800.0]), (1, 0, -1.0, [800.0]), (2, 0, 1.0, [-720.0])])
    w = np.array([1.0])
    with TrainingSet(df, engine=engine) as ts:
        e = ts.evaluate(w, LOGISTIC, Penalty())
        stats = np.array(ts.shard_stats(w, LOGISTIC).first()["stats"])
    assert e.objective == pytest.approx((800.0 + 720.0) / 3)
    assert e.error == pytest.approx(2 / 3)
    assert np.isfinite(e.gradient).all() and np.isfinite(stats).all()


def test_zero_score_is_a_mistake(spark):
    df = small(spark, [(0, 0, 1.0, [0.0]), (1, 0, -1.0, [0.0])])
    assert score.zero_one_error(df, np.array([3.0])).first()["error"] == 1.0
    for engine in ("native", "blocks"):
        with TrainingSet(df, engine=engine) as ts:
            assert ts.mean_error(np.array([3.0]), LOGISTIC) == 1.0


def test_shrink_reaches_exact_zero():
    np.testing.assert_array_equal(shrink(np.array([0.5, -0.5, 2.0, -2.0]), 0.5), [0, 0, 1.5, -1.5])


def test_conjugate_gradient_is_pure_and_exact():
    rng = np.random.default_rng(0)
    q = rng.standard_normal((6, 6))
    a, b, start = q @ q.T + np.eye(6), rng.standard_normal(6), rng.standard_normal(6)
    kept = start.copy()
    for s in (None, start):
        v = conjugate_gradient(lambda p: a @ p, b, 12, start=s)
        np.testing.assert_allclose(a @ v, b, atol=1e-9)
    np.testing.assert_array_equal(start, kept)


def test_elastic_net_forms_agree_and_satisfy_optimality():
    rng = np.random.default_rng(1)
    x, k, b, l1, l2 = rng.standard_normal((40, 5)), rng.random(40), rng.standard_normal(5), 0.3, 0.1
    a = (x * k[:, None]).T @ x + l2 * np.eye(5)
    v = elastic_net_quadratic(a, b, l1)
    u = elastic_net_rows(x, k, l2, b, l1, start=np.zeros(5), sweeps=1000)
    np.testing.assert_allclose(v, u, atol=1e-10)
    g = a @ v - b
    for j in range(5):
        if v[j]:
            assert g[j] == pytest.approx(-l1 * np.sign(v[j]), abs=1e-9)
        else:
            assert abs(g[j]) <= l1 + 1e-9


def test_svrg_uses_short_shards_and_tails():
    x, y = numbers(130, 3)
    for rows in (2, 130):
        b = Block(0, np.arange(rows), y[:rows], x[:rows])
        w = svrg(
            b, LOGISTIC, np.zeros(3), passes=400, rate=0.3, ridge=0.5, shift=np.zeros(3), seed=(0,)
        )
        g = LOGISTIC.slope(b.x @ w, b.y) @ b.x / rows + 0.5 * w
        assert np.abs(g).max() < 1e-8


def test_step_rules():
    etas = np.array([1.0, 0.25, 0.0625])
    assert armijo(etas, np.array([2.0, 0.5, 0.4]), 1.0, 1.0) == 1
    assert armijo(etas, np.array([2.0, 2.0, 2.0]), 1.0, 1.0) == 2
    assert wolfe(etas, np.array([0.5, 0.4, 0.9]), np.array([0.95, 0.1, 0.1]), 1.0, 1.0) == 1
    assert wolfe(etas, np.array([0.5, 0.9, 0.9]), np.array([0.95, 0.95, 0.95]), 1.0, 1.0) == 0
    assert wolfe(etas, np.array([2.0, 2.0, 2.0]), np.array([0.1, 0.1, 0.1]), 1.0, 1.0) == 2


# ---- preparation and sources -----------------------------------------------------------


def test_zero_feature_scales_to_zero(spark):
    df = small(spark, [(0, 0, 1.0, [0.0, 2.0]), (1, 0, 3.0, [0.0, -4.0])])
    scaled = prepare.apply_max_abs(df, prepare.fit_max_abs(df, 2)).orderBy("id").collect()
    assert [r["x"] for r in scaled] == [[0.0, 0.5], [0.0, -1.0]]
    assert [r["y"] for r in scaled] == [-1.0, 1.0]


def test_split_exact_counts_and_refuses_shared_keys(spark):
    df = spark.range(1003)
    sides = prepare.split_exact(df, "id", seed=3).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in sides} == {False: 802, True: 201}
    same = spark.range(500).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError, match="unique"):
        prepare.split_exact(same, "id", max_ties=10)


@pytest.mark.parametrize("draws", ["xxhash", "md5"])
def test_noise_does_not_depend_on_layout_and_has_its_moments(spark, sf, draws):
    df = fx.event2(spark, sf)
    a = prepare.replicate_noise(df, 2, 0.02, seed=1, draws=draws)
    b = prepare.replicate_noise(df.repartition(5), 2, 0.02, seed=1, draws=draws)
    assert a.exceptAll(b).count() == 0
    base = df.select("id", F.col("x").alias("x0"))
    gap = a.join(base, "id").select((F.col("x")[0] - F.col("x0")[0]).alias("e"))
    row = gap.agg(F.avg("e"), F.stddev("e"), F.count("*")).first()
    share = prepare.split_hash(df, "id", seed=2, draws=draws).agg(F.avg(F.col("is_test").cast("int")))
    assert share.first()[0] == pytest.approx(0.2, abs=0.015)
    assert row[2] == 20_000 and abs(row[0]) < 5e-4 and row[1] == pytest.approx(0.02, rel=0.03)


def test_assign_shards_balances_unique_keys(spark):
    counts = prepare.assign_shards(spark.range(20_000), 8, "id").groupBy("shard").count().collect()
    assert len(counts) == 8 and max(r["count"] for r in counts) < 2700


def test_random_features_approximate_the_kernel(spark, sf):
    m = RandomFourier(width=64, size=4096, sigma=2.0)
    df = fx.emb(spark, sf)
    mapped = random_fourier(df, m).orderBy("id").select("x").limit(20).toPandas()["x"]
    z = np.stack(mapped)
    x = np.stack(df.orderBy("id").limit(20).toPandas()["x"])
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-gap / (2 * 2.0**2))).max() < 0.08


def test_random_feature_forms_agree(spark, sf):
    m = RandomFourier(width=2, size=12, sigma=0.7, draws="hash")
    df = fx.event2(spark, sf)
    a, b = (f(df, m).orderBy("id").toPandas()["x"] for f in (random_fourier, random_fourier_native))
    np.testing.assert_allclose(np.stack(a), np.stack(b), atol=1e-12)


def test_bandwidth_narrow_and_wide_match_brute_force(spark):
    for d in (3, 40):
        x, y = numbers(150, d)
        row = bandwidth(table_of(spark, x, y, np.zeros(150)).repartition(5), d).first()
        brute = ((x[:, None] - x[None]) ** 2).sum(-1).mean()
        assert row["mean_sq_dist"] == pytest.approx(brute, rel=1e-12)
        assert row["sigma"] == pytest.approx(brute**0.5, rel=1e-12)


def test_libsvm_widths_are_given_and_indices_checked(spark):
    df = small(spark, [(0, 0, 1.0, [0.0, 2.5, 0.0]), (1, 0, -1.0, [1.0, 0.0, -3.0])])
    path = scratch_path(spark, "t")
    write_libsvm(df, path)
    back = read_libsvm(spark, path, 5, num_partitions=1).orderBy("y").collect()
    assert [r["x"] for r in back] == [[1.0, 0.0, -3.0, 0.0, 0.0], [0.0, 2.5, 0.0, 0.0, 0.0]]
    keyed = read_libsvm(spark, path, 3, row_id=True)
    assert keyed.columns == ["id", "y", "x"] and keyed.select("id").distinct().count() == 2
    parsed = parse_libsvm_text(read_text(spark, path), 3).orderBy("y").collect()
    assert [r["x"] for r in parsed] == [[1.0, 0.0, -3.0], [0.0, 2.5, 0.0]]
    with pytest.raises(Exception, match="index outside"):
        parse_libsvm_text(read_text(spark, path), 2).collect()
    empty = spark.createDataFrame([("-1 ",)], "value STRING")
    assert parse_libsvm_text(empty, 2).first()["x"] == [0.0, 0.0]


def test_relayout(spark):
    df = spark.range(0, 100, 1, 10)
    assert relayout(df, None) is df
    assert relayout(df, 4).rdd.getNumPartitions() == 4
    assert relayout(df, 20, coalesce=False).rdd.getNumPartitions() == 20


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", "")
    assert checkpoint_dir(spark).rstrip("/").find(named.rstrip("/")) >= 0


def test_scoring_wide_and_narrow(spark, sf):
    w = np.linspace(-1, 1, 64)
    df = fx.emb(spark, sf)
    wide = score.score_rows(df, w).orderBy("id").toPandas()
    np.testing.assert_allclose(wide["score"], np.stack(wide["x"]) @ w, atol=1e-12)
    assert score.mean_squared_error(df, w).first()["n"] == 500


def test_an_empty_table_is_named(spark):
    none = spark.createDataFrame([], "y double, x array<double>")
    with pytest.raises(ValueError, match="empty"):
        TrainingSet(none)


def test_large_labels_with_small_residuals(spark):
    """Labels near a million, residuals near a thousandth: no error is negative or quantised."""
    rng = np.random.default_rng(4)
    x = np.stack([np.ones(400), rng.random(400)], axis=1)
    y = x @ np.array([1e6, 3e3]) + 1e-3 * rng.standard_normal(400)
    rows = [(i % 3, i, float(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "shard int, id long, y double, x array<double>")
    for fit in (
        lambda ts: fit_newton(ts, SQUARED, l2=0.0, max_iter=6),
        lambda ts: fit_cg(ts, l2=0.0, max_iter=8),
    ):
        with TrainingSet(df) as ts:
            out = fit(ts)
        direct = float(np.mean((y - x @ out.w) ** 2))
        last = out.history[-1]["train_error"]
        assert out.stopped != "diverged"
        assert min(h["train_error"] for h in out.history) >= 0
        assert last == pytest.approx(direct, rel=1e-4, abs=1e-7)
        assert last < 1e-4
