"""What a task holds grows with its blocks, not with the table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.queries import queries
from fitkit.operators.blocks import Block, join_blocks
from fitkit.operators.losses import LOGISTIC
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.grouped_dual import BLOCK_ROWS, BlockDual, fit_groups_dual
from fitkit.plans.local import uses_statistics


@pytest.mark.parametrize("d", [2, 60, BLOCK_ROWS, 200])
def test_block_solvers_weigh_no_more_than_the_rows(d):
    draw = np.random.default_rng(d)
    x, y = draw.normal(size=(20 * BLOCK_ROWS + 7, d)), draw.normal(size=20 * BLOCK_ROWS + 7)
    dual = BlockDual(x, y, np.zeros(len(y)), 1e-3, 0.1)
    assert sum(m.nbytes for m in dual.solvers) <= 1.1 * x.nbytes
    for i in (0, len(dual.parts) - 1):
        part = x[dual.parts[i]]
        exact = np.linalg.solve(part @ part.T * dual.scale + np.eye(len(part)), y[dual.parts[i]])
        np.testing.assert_allclose(dual.solve(i, y[dual.parts[i]]), exact, atol=1e-10)


def test_groups_count_all_that_a_task_holds(spark):
    """Narrow rows weigh more than their features: this group would not fit."""
    df = spark.range(500).select(
        F.lit("a").alias("name"), F.sin("id").alias("y"), F.array(F.cos("id"), F.lit(1.0)).alias("x")
    )
    want = fit_groups_dual(df, "name", lam=0.05).first()
    got = fit_groups_dual(df, "name", lam=0.05, group_bytes=500 * 40).first()
    assert want["epochs"] is not None and got["epochs"] is None
    assert np.allclose(got["w"], want["w"], atol=1e-5)


def narrow(spark, n):
    return spark.range(0, n, 1, 2).select(
        "id", F.pmod("id", F.lit(2)).cast("int").alias("shard"),
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("y"),
        F.array(F.sin("id"), F.cos("id")).alias("x"),
    )


@pytest.mark.parametrize("form", ["blocks", "pure_blocks", "gathered"])
def test_batches_of_blocks_weigh_no_more_than_two_blocks(spark, form):
    def weigh(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["b"])

    size = 1 << 15
    with TrainingSet(narrow(spark, 15_000), block_bytes=size) as ts, ts.block_batches():
        found = [r[0] for r in getattr(ts, form).mapInArrow(weigh, "b long").collect()]
    assert sum(found) >= 15_000 * 32 and max(found) <= 2 * size


def test_shards_are_gathered_only_where_copies_fit_a_task(spark):
    """Features of a shard fit a task, four copies of whole rows do not."""
    with TrainingSet(narrow(spark, 8_000), shard_bytes=4_000 * 64) as ts:
        assert not ts.has_oversized_shard and uses_statistics(ts, LOGISTIC, 100)
    with TrainingSet(narrow(spark, 8_000)) as ts:
        assert not uses_statistics(ts, LOGISTIC, 100)


def test_joined_blocks_keep_ties_in_order():
    def block(ids, start):
        y = np.arange(start, start + len(ids), dtype=float)
        return Block(3, np.array(ids), y, np.stack([y, -y], axis=1))

    got = join_blocks([block([5, 1, 5], 0), block([1, 9], 3), block([0], 5)])
    assert got.ids.tolist() == [0, 1, 1, 5, 5, 9] and got.y.tolist() == [5, 1, 3, 0, 2, 4]
    assert (got.x == np.stack([got.y, -got.y], axis=1)).all()


def test_tiles_are_not_read_again_without_the_batch_limit(spark, sf):
    out = queries()["gram_matrix_tiled"](spark, sf)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
