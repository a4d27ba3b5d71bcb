"""Streamed epochs, co-partitioned ADMM state, exact splits of tables with repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators import prepare
from fitkit.operators.blocks import Block
from fitkit.operators.losses import LOGISTIC, SQUARED
from fitkit.operators.training_set import TrainingSet
from fitkit.plans import admm, epochs
from fitkit.plans.admm import fit_admm
from fitkit.plans.dane import fit_dane
from fitkit.plans.local import average_models
from fitkit.plans.newton import fit_newton
from fitkit.session import TableChain

L2 = 0.05


@pytest.fixture(scope="module")
def rows(spark, sf):
    return fx.emb(spark, sf).repartition(5).cache()


def in_hand(rows, seed):
    """Every shard as a block, its rows in the seeded order that Spark gives."""
    table = rows.orderBy("shard", F.xxhash64(F.lit(seed), F.col("id")), "id").toPandas()
    for shard, part in table.groupby("shard"):
        yield shard, Block(shard, part["id"].to_numpy(), part["y"].to_numpy(), np.stack(part["x"]))


@pytest.mark.parametrize("block_bytes", [1 << 20, 64 * 8 * 130])
def test_streamed_epochs_equal_the_shard_at_hand(rows, block_bytes):
    start, shift = np.linspace(-0.1, 0.1, 64), np.linspace(0.02, -0.02, 64)
    options = dict(passes=3, rate=0.8, ridge=L2)
    with TrainingSet(rows, block_bytes=block_bytes) as ts:
        blocks = epochs.in_epochs(ts, 3)
        state = epochs.start_state(blocks, start, shift)
        state, chain = epochs.run_epochs(ts, blocks, LOGISTIC, state, weight=lambda s: s / 100, **options)
        got = {r["shard"]: np.frombuffer(r["w"]) for r in state.collect()}
        chain.close()
    for shard, b in in_hand(rows, 3):
        want = epochs.svrg_in_order(b, LOGISTIC, start, shift=shift, loss_weight=len(b.y) / 100, **options)
        assert np.allclose(got.pop(shard), want, rtol=0, atol=1e-12)
    assert not got


def test_a_shard_beyond_a_task_is_walked_not_refused(rows):
    hot = rows.withColumn("shard", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5 + 1).cast("int"))
    options = dict(l2=L2, max_iter=2, inner=2, rate=0.8, seed=4)
    with TrainingSet(hot, shard_bytes=20_000) as one, TrainingSet(hot) as two:
        assert one.has_oversized_shard
        got, want = fit_dane(one, **options), fit_dane(two, streamed=True, **options)
        assert "gathered" not in one.__dict__
        assert np.allclose(got.w, want.w, rtol=0, atol=1e-12)
        averaged = average_models(one, LOGISTIC, l2=L2, inner=2, rate=0.8, seed=4)
        total = sum(len(b.y) for _, b in in_hand(hot, 4))
        plain = sum(
            len(b.y) / total * epochs.svrg_in_order(b, LOGISTIC, np.zeros(64), passes=2, rate=0.8, ridge=L2, shift=np.zeros(64))
            for _, b in in_hand(hot, 4)
        )
        assert np.allclose(averaged, plain, rtol=0, atol=1e-12)
        with pytest.raises(ValueError, match="lockstep"):
            one.gathered  # noqa: B018


def test_streamed_admm_nears_the_optimum(rows):
    with TrainingSet(rows) as ts:
        best = fit_newton(ts, LOGISTIC, l2=L2, max_iter=8)
        fit = fit_admm(ts, LOGISTIC, l2=L2, max_iter=3, inner=2, rate=1.0, rho=0.05, streamed=True)
    assert best.objective < fit.objective < fit.history[0]["objective"]
    assert [h["iter"] for h in fit.history] == list(range(4))


def test_shards_take_turns(rows, monkeypatch):
    options = dict(l2=L2, max_iter=1, inner=2, rate=0.8, streamed=True)
    with TrainingSet(rows) as ts:
        want = fit_dane(ts, **options)
        monkeypatch.setattr(epochs, "ASK_BYTES", 64 * 8)
        assert np.allclose(fit_dane(ts, **options).w, want.w, rtol=0, atol=1e-13)


def plan_of(df):
    """Names of the operators of a plan, without what lies below a cached table."""
    names, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        names.append(node.nodeName())
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    return names


def test_admm_rounds_move_the_state_only(rows, monkeypatch):
    plans, kept = [], []
    put = TableChain.put

    def watched(self, df):
        plans.append(plan_of(df))
        out = put(self, df)
        kept.append(len(self.paths))
        return out

    monkeypatch.setattr(TableChain, "put", watched)
    for loss in (SQUARED, LOGISTIC):
        plans.clear()
        with TrainingSet(rows, engine="blocks") as ts:
            fit_admm(ts, loss, l2=L2, max_iter=3, inner=3, rate=0.5, rho=0.1)
        joins = [p for p in plans if "SortMergeJoin" in p]
        assert len(joins) == 3
        for plan in joins:
            # The data side comes from the cache as it lies; the state, read from its table, is dealt.
            assert plan.count("InMemoryTableScan") == 1 and plan.count("Exchange") == 1, plan
    assert max(kept) <= 2


def test_ridge_by_statistics_caches_no_rows(spark, sf):
    with TrainingSet(fx.ridge2(spark, sf)) as ts:
        fit_newton(ts, SQUARED, l2=L2, max_iter=2)
        assert "flat" not in ts.__dict__ and "blocks" not in ts.__dict__


def sides(df, **options):
    out = prepare.split_exact(df, "id", **options)
    return out, {r["is_test"]: r["count"] for r in out.groupBy("is_test").count().collect()}


def test_split_of_equal_rows(spark):
    same = spark.range(5000).select(F.lit(1).alias("id"), F.array(F.lit(0.5)).alias("x"))
    out, counts = sides(same, train_fraction=0.3)
    assert counts == {False: 1500, True: 3500}
    assert out.drop("is_test").exceptAll(same).count() == 0


@pytest.mark.parametrize("fraction", [0.01, 0.37, 0.8, 0.999])
def test_split_of_shared_keys(spark, fraction):
    """Two keys for all rows, nulls, rows that repeat in part and whole."""
    df = spark.range(3001).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(8).cast("long").alias("id"),
        (F.col("id") % 11).cast("double").alias("v"),
        F.when(F.col("id") % 5 > 0, F.create_map(F.lit("k"), F.col("id") % 2)).alias("m"),
    )
    n_train = int(np.floor(fraction * 3001))
    out, counts = sides(df, seed=5, train_fraction=fraction)
    assert counts == {False: n_train, True: 3001 - n_train}
    again, _ = sides(df.repartition(7), seed=5, train_fraction=fraction)
    text = lambda t: sorted(r[0] for r in t.select(F.to_json(F.struct("*"))).collect())
    assert text(out) == text(again)
    assert text(out.drop("is_test")) == text(df)


def test_split_of_empty_and_single_tables(spark):
    assert sides(spark.range(0))[1] == {}
    assert sides(spark.range(1))[1] == {True: 1}
    assert admm.DEFAULT_RHO == 0.1
