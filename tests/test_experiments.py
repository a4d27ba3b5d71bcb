"""Presets end to end from libsvm files, with shortened iteration counts."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators.losses import LOGISTIC, SQUARED
from fitkit.plans import experiments as ex
from fitkit.session import scratch_path
from fitkit.sources import write_libsvm


@pytest.fixture(scope="module")
def files(spark, sf):
    df = fx.emb(spark, sf)
    train, test = scratch_path(spark, "train"), scratch_path(spark, "test")
    label = F.col("y") * 0.5 + 1.5  # back to {1, 2}
    write_libsvm(df.filter("id % 5 <> 0").withColumn("y", label), train)
    write_libsvm(df.filter("id % 5 = 0").withColumn("y", label), test)
    return train, test


SHORT = {
    "covtype": {
        "newton": ex.newton(LOGISTIC, 1e-4, 3, 30),
        "dane": ex.dane(1e-4, 2, 3, 1.0),
        "momentum": ex.momentum(1e-4, 3, 1.0, 0.9),
        "lbfgs": ex.lbfgs(LOGISTIC, 1e-4, 3, 10),
    },
    "elastic_net": {
        "prox_newton": ex.prox_newton(1e-4, 1e-6, 2, 10),
        "fista": ex.fista(1e-4, 1e-6, 2, 1.0),
    },
    "ridge_fourier": {
        "newton": ex.newton(SQUARED, 1e-4, 2, 10),
        "admm": ex.admm(SQUARED, 1e-3, 2, 10),
        "cg": ex.cg(1e-4, 3),
        "lbfgs": ex.lbfgs(SQUARED, 1e-4, 2, 5),
    },
}


@pytest.mark.parametrize("name", sorted(SHORT))
def test_preset(spark, files, name):
    preset = dataclasses.replace(ex.EXPERIMENTS[name], grid=SHORT[name])
    features = 48 if preset.sigma is not None else None
    history, summary = ex.run_experiment(spark, preset, *files, d=64, m=3, features=features)
    rows = summary.collect()
    assert {r["run_id"] for r in rows} == set(SHORT[name])
    assert all(r["stopped"] != "diverged" and r["test_error"] is not None for r in rows)
    first = history.filter("iter = 0").agg(F.max("objective")).first()[0]
    assert all(r["objective"] < first for r in rows)


def test_every_preset_names_its_grid():
    assert set(ex.EXPERIMENTS) == {
        "covtype", "epsilon", "mnist", "ridge", "ridge_fourier", "elastic_net",
    }
    assert all(callable(f) for e in ex.EXPERIMENTS.values() for f in e.grid.values())


def test_preset_does_not_depend_on_the_file_layout(spark, files):
    """The same rows in one file and in seven give the same shards and the same fits."""
    preset = dataclasses.replace(ex.EXPERIMENTS["covtype"], grid=SHORT["covtype"], sigma=None)
    found = []
    for pieces in (1, 7):
        path = scratch_path(spark, "layout")
        spark.read.format("libsvm").option("numFeatures", "64").load(files[0]).repartition(
            pieces
        ).write.format("libsvm").save(path)
        _, summary = ex.run_experiment(spark, preset, path, files[1], d=64, m=3)
        found.append({r["run_id"]: (r["objective"], r["test_error"]) for r in summary.collect()})
    assert found[0].keys() == SHORT["covtype"].keys()
    for run_id, values in found[0].items():
        assert values == pytest.approx(found[1][run_id], rel=1e-9)
