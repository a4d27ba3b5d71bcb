"""One query per operator, each over whole tables of the given data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from fitkit.operators import prepare, score
from fitkit.operators.blocks import Shape, iter_shards
from fitkit.operators.features import (
    RandomFourier,
    bandwidth,
    bandwidth_by_shard,
    random_fourier,
    random_fourier_native,
)
from fitkit.operators.losses import LOGISTIC, SQUARED, Penalty
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.admm import fit_admm
from fitkit.plans.dane import fit_dane
from fitkit.plans.experiments import EXPERIMENTS, run_experiment
from fitkit.plans.gradient import fit_cg, fit_fista, fit_lbfgs, fit_momentum
from fitkit.plans.grouped import fit_groups
from fitkit.plans.grouped_dual import fit_groups_dual
from fitkit.plans.local import average_models
from fitkit.plans.loop import FitResult
from fitkit.plans.newton import fit_newton, fit_prox_newton
from fitkit.plans.steps import armijo, step_table
from fitkit.plans.sweep import run_sweep
from fitkit.plans.vector_free import fit_lbfgs_vector_free
from fitkit.session import TableChain, scratch_path
from fitkit.sources import (
    parse_libsvm_text,
    read_libsvm,
    read_text,
    relayout,
    write_libsvm,
    write_text_split,
)

Query = Callable[[SparkSession, str], DataFrame]

W = np.array([0.3, -0.2])
P = np.array([0.15, -0.4])
L2 = 0.01


def r(column, name: str, digits: int = 7):
    """Rounded and free of negative zeros, as the SQL twins do it."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.round(column.cast("double"), digits) + F.lit(0.0)).alias(name)


def big(column: str):
    return F.col(column).cast("bigint").alias(column)


def rows(spark: SparkSession, values, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def clean(v: float, digits: int = 7) -> float:
    return round(float(v), digits) + 0.0


def history_table(spark: SparkSession, fit: FitResult) -> DataFrame:
    """History of a two-feature fit with the weights of every iteration."""
    values = [
        (
            h["iter"],
            clean(h["objective"]),
            clean(h["train_error"]),
            clean(h["grad_norm_sq"]),
            None if h["step"] is None else clean(h["step"]),
            clean(w[0]),
            clean(w[1]),
        )
        for h, w in zip(fit.history, fit.path)
    ]
    return rows(
        spark,
        values,
        "iter BIGINT, objective DOUBLE, train_error DOUBLE, grad_norm_sq DOUBLE, step DOUBLE, "
        "w0 DOUBLE, w1 DOUBLE",
    )


def fitted(fixture, fit, drop: tuple[str, ...] = (), **options) -> Query:
    """Query that returns the history of ``fit(training_set)`` on a fixture."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with TrainingSet(fixture(spark, sf_dir), **options) as ts:
            return history_table(spark, fit(ts)).drop(*drop)

    return query


def on_set(fixture, body, **options) -> Query:
    """Query that computes something on a training set before its caches go."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        with TrainingSet(fixture(spark, sf_dir), **options) as ts:
            return body(spark, ts)

    return query


# ---- sources, sinks, layout ------------------------------------------------------


def _libsvm_rows(df: DataFrame) -> DataFrame:
    ramp = F.aggregate(
        F.transform("x", lambda v, j: v * (j + 1)), F.lit(0.0), lambda a, v: a + v
    )
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return df.select(
        "y",
        r(F.col("x")[0], "first"),
        r(F.col("x")[63], "last"),
        r(total, "total"),
        r(ramp, "ramp"),
    )


def libsvm_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "libsvm")
    write_libsvm(fx.emb(spark, sf_dir), path)
    return _libsvm_rows(read_libsvm(spark, path, 64, num_partitions=4))


def _libsvm_lines(df: DataFrame) -> DataFrame:
    """Sparse libsvm text lines (zeros left out)."""
    pairs = F.filter(
        F.transform("x", lambda v, j: F.struct((j + 1).alias("j"), v.alias("v"))),
        lambda p: p["v"] != 0.0,
    )
    words = F.transform(
        pairs, lambda p: F.concat_ws(":", p["j"].cast("string"), p["v"].cast("string"))
    )
    label = F.col("y").cast("string")
    return df.select("id", F.concat_ws(" ", label, F.array_join(words, " ")).alias("value"))


def libsvm_text_parse(spark, sf_dir):
    path = scratch_path(spark, "lines")
    _libsvm_lines(fx.emb(spark, sf_dir)).select("value").write.text(path)
    return _libsvm_rows(parse_libsvm_text(read_text(spark, path), 64))


def text_split_sink(spark, sf_dir):
    path = scratch_path(spark, "split")
    lines = prepare.split_modulo(_libsvm_lines(fx.emb(spark, sf_dir)), "id", every=5)
    write_text_split(lines, path, F.col("is_test"))
    sides = [
        read_text(spark, path + side).withColumn("is_test", F.lit(test))
        for side, test in (("_train", False), ("_test", True))
    ]
    positive = F.sum(F.when(F.col("value").startswith("1.0"), 1).otherwise(0))
    return (
        sides[0]
        .union(sides[1])
        .groupBy("is_test")
        .agg(F.count("*").alias("n"), positive.alias("positive"))
    )


def shard_assign(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem").select("l_orderkey")
    sharded = prepare.assign_shards(items, 8, "l_orderkey", hashed=False)
    return relayout(sharded, 4).groupBy("shard").agg(F.count("*").alias("n")).select(
        big("shard"), "n"
    )


def _shard_blocks(spark, ts):
    def kernel(batches):
        for b in iter_shards(batches, Shape(2)):
            values = [b.shard, len(b.y), b.ids[0], b.ids[-1]]  # shard is the slot label
            sums = [b.x[0, 0], b.y.sum(), b.y @ b.x[:, 0], b.y @ b.x[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(v)], pa.int64()) for v in values]
                + [pa.array([float(v)], pa.float64()) for v in sums],
                ["label", "s", "first_id", "last_id", "first_x0", "sum_y", "sum_yx0", "sum_yx1"],
            )

    out = ts.gathered.mapInArrow(
        kernel,
        "label BIGINT, s BIGINT, first_id BIGINT, last_id BIGINT, first_x0 DOUBLE, sum_y DOUBLE, "
        "sum_yx0 DOUBLE, sum_yx1 DOUBLE",
    ).join(ts.slot_table().select("shard", F.explode("labels").alias("label")), "label")
    out = out.select(
        big("shard"), "s", "first_id", "last_id", *[r(c, c) for c in ("first_x0", "sum_y", "sum_yx0", "sum_yx1")]
    )
    return rows(spark, out.collect(), out.schema.simpleString()[7:-1])


# ---- preparation -------------------------------------------------------------------


def label_recode(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1).alias("y"))
    return prepare.recode_affine(labels, 1.5, 0.5)


def label_recode_condition(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    recoded = prepare.recode_binary(orders, F.col("o_orderstatus") == "F")
    return recoded.select("o_orderkey", "y")


def class_filter(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    kept = prepare.keep_classes(vectors, "label", [4, 9])
    return prepare.recode_affine(kept.withColumnRenamed("label", "y"), 6.5, 2.5)


def _stats_table(spark, stats: prepare.ScaleStats):
    return stats.to_df(spark).select(big("j"), r("max_abs", "max_abs"), r("y_mean", "y_mean"))


def maxabs_fit(spark, sf_dir):
    return _stats_table(spark, prepare.fit_max_abs(fx.ridge3(spark, sf_dir), 3))


def maxabs_fit_wide(spark, sf_dir):
    """The Arrow form of the fit, the one used for wide features."""
    return _stats_table(spark, prepare.fit_max_abs_batched(fx.emb(spark, sf_dir), 64))


def maxabs_apply(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("y"),
        F.array("value", F.col("user_id").cast("double"), F.lit(0.0)).alias("x"),
    )
    scaled = prepare.apply_max_abs(events, prepare.fit_max_abs(events, 3))
    return scaled.select("event_id", r("y", "y"), *[r(F.col("x")[j], f"x{j}") for j in range(3)])


def split_hash(spark, sf_dir):
    return prepare.split_hash(
        fx.table(spark, sf_dir, "events").select("event_id"), "event_id", seed=7, draws="md5"
    )


def split_exact(spark, sf_dir):
    return prepare.split_exact(
        fx.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=11
    )


def split_exact_duplicates(spark, sf_dir):
    """Lineitem by order key, which repeats: exact sides, cut among rows of one key."""
    sides = prepare.split_exact(fx.table(spark, sf_dir, "lineitem"), "l_orderkey", seed=11)
    return sides.groupBy("l_orderkey").agg(
        F.count(F.when(~F.col("is_test"), 1)).alias("n_train"),
        F.count(F.when(F.col("is_test"), 1)).alias("n_test"),
        r(F.sum("l_quantity"), "quantity"),
    )


def split_mod5(spark, sf_dir):
    return prepare.split_modulo(
        fx.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", every=5
    )


def augment_noise(spark, sf_dir):
    noisy = prepare.replicate_noise(fx.event2(spark, sf_dir), 5, 0.02, seed=5, draws="md5")
    return noisy.select("id", big("copy"), r(F.col("x")[0], "x0"), r(F.col("x")[1], "x1"))


FOURIER = RandomFourier(width=64, size=16, sigma=1.5, draws="hash")


def _features(df: DataFrame) -> DataFrame:
    long = df.select("id", F.posexplode("x").alias("j", "feature"))
    return long.select("id", big("j"), r("feature", "feature"))


def rff_transform(spark, sf_dir):
    return _features(random_fourier(fx.emb(spark, sf_dir), FOURIER))


def rff_transform_native(spark, sf_dir):
    return _features(random_fourier_native(fx.emb(spark, sf_dir), FOURIER))


def _bandwidth(df: DataFrame) -> DataFrame:
    return df.select("n", r("mean_sq_dist", "mean_sq_dist"), r("sigma", "sigma"))


def rff_bandwidth(spark, sf_dir):
    return _bandwidth(bandwidth(fx.emb(spark, sf_dir), 64))


def rff_bandwidth_by_shard(spark, sf_dir):
    return _bandwidth(bandwidth_by_shard(fx.event2(spark, sf_dir)))


# ---- sums --------------------------------------------------------------------------


def _profile(spark, ts):
    p = ts.prepare(LOGISTIC).profile
    return rows(
        spark,
        [(p.n, p.d, ts.m, p.odd_labels, p.positive_labels)],
        "n BIGINT, d BIGINT, m BIGINT, odd_labels BIGINT, positive_labels BIGINT",
    )


def _gradient(loss, penalty):
    def body(spark, ts):
        e = ts.evaluate(W, loss, penalty)
        smooth = e.gradient
        if penalty.l1:
            smooth = smooth - penalty.gradient(W)  # the elastic-net sum is of the loss alone
        values = [clean(e.objective), clean(e.error), clean(smooth[0]), clean(smooth[1])]
        return rows(
            spark,
            [(ts.n, *values)],
            "n BIGINT, objective DOUBLE, error DOUBLE, g0 DOUBLE, g1 DOUBLE",
        )

    return body


def _gradient_wide(spark, ts):
    w = np.array([((k % 7) - 3) / 10.0 for k in range(64)])
    g = ts.evaluate(w, LOGISTIC, Penalty(l2=L2)).gradient
    return rows(spark, [(j, clean(v)) for j, v in enumerate(g)], "j BIGINT, g DOUBLE")


def _line(slopes: bool):
    def body(spark, ts):
        etas = step_table(LOGISTIC)
        f, s, _ = ts.line(W, P, etas, LOGISTIC, Penalty(l2=L2), slopes=slopes)
        values = [
            (k, float(e), clean(f[k])) + ((clean(s[k]),) if slopes else ())
            for k, e in enumerate(etas)
        ]
        schema = "k BIGINT, eta DOUBLE, objective DOUBLE" + (", slope DOUBLE" if slopes else "")
        return rows(spark, values, schema)

    return body


def _armijo(spark, ts):
    etas, penalty = step_table(LOGISTIC), Penalty(l2=L2)
    e = ts.evaluate(W, LOGISTIC, penalty)
    p = 16.0 * e.gradient
    f, _, _ = ts.line(W, p, etas, LOGISTIC, penalty)
    best = armijo(etas, f, e.objective, float(p @ e.gradient))
    values = [(k, float(eta), clean(f[k]), k == best) for k, eta in enumerate(etas)]
    return rows(spark, values, "k BIGINT, eta DOUBLE, objective DOUBLE, picked BOOLEAN")


def _vector(name: str, compute):
    def body(spark, ts):
        v = compute(ts) / ts.n
        return rows(spark, [(j, clean(x)) for j, x in enumerate(v)], f"j BIGINT, {name} DOUBLE")

    return body


def _matrices(loss, w):
    """Per-shard mean curvature matrices in long form."""

    def body(spark, ts):
        d = ts.d
        stats = ts.shard_stats(np.zeros(d) if w is None else w, loss)
        cell = F.posexplode(F.slice("stats", 1, d * d)).alias("at", "h")
        long = stats.select("shard", "s", cell).select(
            big("shard"),
            F.expr(f"cast(floor(at / {d}) AS BIGINT)").alias("i"),
            F.expr(f"cast(at % {d} AS BIGINT)").alias("j"),
            r(F.col("h") / F.col("s"), "v"),
        )
        return rows(spark, long.collect(), "shard BIGINT, i BIGINT, j BIGINT, v DOUBLE")

    return body


def _tiles(spark, ts):
    """Every tile of the mean Gram matrices: the sum of its entries, the first and the last one."""

    def kernel(batches):
        for batch in batches:
            names = batch.schema.names
            cells = [np.frombuffer(c.as_buffer()) for c in batch.column(names.index("tile"))]
            s = batch.column(names.index("s")).to_numpy(zero_copy_only=False)
            digests = [[c.sum(), c[0], c[-1]] for c in cells]
            columns = np.array(digests).reshape(-1, 3).T / s
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(n)) for n in ("shard", "i", "j", "s")] + [pa.array(c) for c in columns],
                ["shard", "i", "j", "s", "total", "first", "last"],
            )

    with ts.block_batches():
        tiles = ts.shard_tiles(np.zeros(ts.d), SQUARED)
        found = tiles.mapInArrow(
            kernel, "shard INT, i INT, j INT, s BIGINT, total DOUBLE, first DOUBLE, last DOUBLE"
        )
        # Written here: a later job would read blocks and tiles without the limit, 10,000 in a batch.
        found = TableChain(spark, "tiles").put(found)
    return found.select(*[big(c) for c in ("shard", "i", "j", "s")], *[r(c, c) for c in ("total", "first", "last")])


# ---- trainers ----------------------------------------------------------------------


def _weights(spark, fit: FitResult, digits: int) -> DataFrame:
    last = fit.history[-1]
    values = [
        (j, clean(w, digits), clean(last["objective"], digits), clean(last["train_error"]))
        for j, w in enumerate(fit.w)
    ]
    return rows(spark, values, "j BIGINT, w DOUBLE, objective DOUBLE, train_error DOUBLE")


def _dane(spark, ts):
    return _weights(spark, fit_dane(ts, l2=0.1, max_iter=6, inner=20, rate=2.0), 5)


def _admm_logistic(spark, ts):
    fit = fit_admm(ts, LOGISTIC, l2=0.1, max_iter=22, inner=10, rate=2.0, rho=0.1)
    return _weights(spark, fit, 4)


def _averaged_path(streamed: bool):
    """Weights of one-shot averaging after few epochs, far from any optimum."""

    def body(spark, ts):
        w = average_models(ts, LOGISTIC, l2=0.05, inner=3, rate=0.7, streamed=streamed)
        return rows(spark, [(j, clean(v)) for j, v in enumerate(w)], "j BIGINT, w DOUBLE")

    return body


def _average(loss, l2, digits, **options):
    def body(spark, ts):
        w = average_models(ts, loss, l2=l2, **options)
        return rows(spark, [(j, clean(v, digits)) for j, v in enumerate(w)], "j BIGINT, w DOUBLE")

    return body


def _grouped(spark, ts):
    out = fit_groups(ts, lam=0.05, sigma=0.5).select(
        big("shard"),
        "s",
        r(F.col("w")[0], "w0"),
        r(F.col("w")[1], "w1"),
        r("objective", "objective"),
    )
    return rows(
        spark, out.collect(), "shard BIGINT, s BIGINT, w0 DOUBLE, w1 DOUBLE, objective DOUBLE"
    )


def history_with_holdout(spark, sf_dir):
    sides = prepare.split_modulo(fx.event2(spark, sf_dir), "id", every=5)
    train, test = sides.filter(~F.col("is_test")), sides.filter("is_test")
    with TrainingSet(train) as ts, TrainingSet(test) as held_out:
        fit = fit_momentum(
            ts, LOGISTIC, l2=L2, max_iter=3, rate=2.0, momentum=0.9, held_out=held_out
        )
    return fit.history_df().select(
        big("iter"), *[r(c, c) for c in ("objective", "train_error", "test_error")]
    )


def _grouped_dual(key: Column, lam: float, weights: bool = True, **options) -> Query:
    """Fits by a string key, with a tilt; every duality gap is below 1e-8."""

    def query(spark, sf_dir):
        data = fx.table(spark, sf_dir, "lineitem").select(
            key.alias("name"),
            (F.col("l_extendedprice") / 100000.0).alias("y"),
            F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0).alias("x"),
        )
        tilt = np.array([0.3, -0.1])
        out = fit_groups_dual(data, "name", lam=lam, sigma=0.5, tilt=tilt, **options)
        found = out.select(
            F.col("key").alias("name"),
            "s",
            r(F.col("w")[0], "w0", 4),
            r(F.col("w")[1], "w1", 4),
            r("objective", "objective"),
            (F.col("gap") < 1e-8).alias("certified"),
        )
        return found if weights else found.drop("w0", "w1")

    return query


def small_group() -> Column:
    return F.concat_ws("-", "l_returnflag", F.col("l_orderkey") % 50)


def _sweep_batched(spark, ts):
    """Six settings over shared passes."""

    def member(rate, beta):
        return lambda s: fit_momentum(s, LOGISTIC, l2=L2, max_iter=2, rate=rate, momentum=beta)

    grid = {f"{a}-{b}": member(a, b) for a in (0.5, 1.0, 2.0) for b in (0.5, 0.9)}
    table, _ = run_sweep(ts, grid, batched=True)
    return table.select(
        "run_id", big("iter"), *[r(c, c) for c in ("objective", "train_error", "grad_norm_sq")]
    )


def _sweep(spark, ts):
    table, _ = run_sweep(
        ts,
        {
            "slow": lambda s: fit_momentum(s, LOGISTIC, l2=L2, max_iter=2, rate=0.5, momentum=0.9),
            "fast": lambda s: fit_momentum(s, LOGISTIC, l2=L2, max_iter=2, rate=2.0, momentum=0.5),
        },
    )
    return table.select(
        "run_id", big("iter"), *[r(c, c) for c in ("objective", "train_error", "grad_norm_sq")]
    )


def preset_ridge(spark, sf_dir):
    """A preset from libsvm files to its summary: scale, shard, fit, held-out error."""
    rows = fx.ridge2(spark, sf_dir).withColumn("side", F.expr("shard = 0"))
    paths = [scratch_path(spark, "preset") for _ in range(2)]
    for path, side in zip(paths, (False, True)):
        write_libsvm(rows.filter(F.col("side") == side).drop("side"), path)
    _, summary = run_experiment(spark, EXPERIMENTS["ridge"], *paths, d=2, m=4)
    return summary.select(
        "run_id", r("objective", "objective"), r("test_error", "test_error"), "nonzero"
    )


# ---- scoring -----------------------------------------------------------------------


def score_rows(spark, sf_dir):
    return score.score_rows(fx.event2(spark, sf_dir), W).select("id", r("score", "score"))


def score_zero_one(spark, sf_dir):
    return score.zero_one_error(fx.logit2(spark, sf_dir), W).select("n", r("error", "error"))


def score_mse(spark, sf_dir):
    return score.mean_squared_error(fx.ridge2(spark, sf_dir), W).select("n", r("mse", "mse"))


def _sparsity(spark, ts):
    fit = fit_fista(ts, l1=0.002, l2=0.0, max_iter=1, lipschitz=1.0)
    return score.weight_sparsity(fit.weights_df()).select("d", "nonzero", r("share", "share"))


#: Converged ridge fits on labels around 1e5, which no scaling has touched.
UNSCALED = {
    "newton": lambda ts: fit_newton(ts, SQUARED, l2=L2, max_iter=12),
    "cg": lambda ts: fit_cg(ts, l2=L2, max_iter=8),
    "lbfgs": lambda ts: fit_lbfgs(ts, SQUARED, l2=L2, max_iter=25),
    "admm": lambda ts: fit_admm(ts, SQUARED, l2=L2, max_iter=40, inner=20, rho=0.1),
}


def _unscaled(fit):
    """Weights and training error at the optimum, to about six digits."""

    def query(spark, sf_dir):
        with TrainingSet(fx.orders2(spark, sf_dir)) as ts:
            out = fit(ts)
        error = out.history[-1]["train_error"]
        return out.weights_df().select(
            F.col("j").cast("long").alias("j"),
            F.round(F.col("w") / 1000, 2).alias("w_thousands"),
            F.round(F.lit(error) / 1e7, 2).alias("error_1e7"),
        )

    return query


def queries() -> dict[str, Query]:
    return {
        "libsvm_roundtrip": libsvm_roundtrip,
        "libsvm_text_parse": libsvm_text_parse,
        "text_split_sink": text_split_sink,
        "shard_assign": shard_assign,
        "shard_blocks": on_set(fx.event2, _shard_blocks),
        "label_recode": label_recode,
        "label_recode_condition": label_recode_condition,
        "class_filter": class_filter,
        "maxabs_fit": maxabs_fit,
        "maxabs_fit_wide": maxabs_fit_wide,
        "maxabs_apply": maxabs_apply,
        "split_hash": split_hash,
        "split_exact": split_exact,
        "split_exact_duplicates": split_exact_duplicates,
        "split_mod5": split_mod5,
        "augment_noise": augment_noise,
        "rff_transform": rff_transform,
        "rff_transform_native": rff_transform_native,
        "rff_bandwidth": rff_bandwidth,
        "rff_bandwidth_by_shard": rff_bandwidth_by_shard,
        "dataset_profile": on_set(fx.logit2, _profile),
        "logistic_grad": on_set(fx.logit2, _gradient(LOGISTIC, Penalty(l2=L2))),
        "ridge_grad": on_set(fx.ridge2, _gradient(SQUARED, Penalty(l2=L2))),
        "enet_grad": on_set(fx.logit2, _gradient(LOGISTIC, Penalty(l2=L2, l1=0.002))),
        "logistic_grad_wide": on_set(fx.emb, _gradient_wide),
        "line_search_table": on_set(fx.logit2, _line(False)),
        "wolfe_table": on_set(fx.logit2, _line(True)),
        "armijo_pick": on_set(fx.logit2, _armijo),
        "ridge_moments": on_set(fx.ridge3, _vector("xy", lambda ts: ts.moments())),
        "gram_matvec": on_set(
            fx.ridge3, _vector("v", lambda ts: ts.gram_apply(np.array([0.5, -0.25, 0.125])))
        ),
        "gram_matrix": on_set(fx.ridge3, _matrices(SQUARED, None)),
        "gram_matrix_wide": on_set(fx.emb, _matrices(SQUARED, None)),
        "logistic_hessian": on_set(fx.logit2, _matrices(LOGISTIC, W)),
        "gram_matrix_tiled": on_set(fx.emb_products, _tiles),
        "newton_logistic_lockstep": fitted(
            fx.logit2, lambda ts: fit_newton(ts, LOGISTIC, l2=L2, max_iter=3, hessian="lockstep")
        ),
        "newton_ridge_tiled": fitted(
            fx.ridge2,
            lambda ts: fit_newton(ts, SQUARED, l2=L2, max_iter=2, hessian="tiled", tile=1),
            engine="blocks",
        ),
        "prox_newton_lockstep": fitted(
            fx.event2,
            lambda ts: fit_prox_newton(ts, l1=0.002, l2=L2, max_iter=3, lockstep_solves=True),
            ("grad_norm_sq",),
        ),
        "newton_ridge": fitted(fx.ridge2, lambda ts: fit_newton(ts, SQUARED, l2=L2, max_iter=2)),
        "newton_logistic": fitted(
            fx.logit2, lambda ts: fit_newton(ts, LOGISTIC, l2=L2, max_iter=3)
        ),
        "prox_newton": fitted(
            fx.event2,
            lambda ts: fit_prox_newton(ts, l1=0.002, l2=L2, max_iter=3),
            ("grad_norm_sq",),
        ),
        "momentum_gd": fitted(
            fx.logit2,
            lambda ts: fit_momentum(ts, LOGISTIC, l2=L2, max_iter=3, rate=2.0, momentum=0.9),
        ),
        "lbfgs_logistic": fitted(fx.logit2, lambda ts: fit_lbfgs(ts, LOGISTIC, l2=L2, max_iter=2)),
        "lbfgs_vector_free": fitted(
            fx.logit2,
            lambda ts: fit_lbfgs_vector_free(
                ts, LOGISTIC, l2=L2, max_iter=2, chunk=1, keep_path=True
            ),
        ),
        "lbfgs_ridge": fitted(fx.ridge2, lambda ts: fit_lbfgs(ts, SQUARED, l2=L2, max_iter=2)),
        **{f"ridge_unscaled_{k}": _unscaled(fit) for k, fit in UNSCALED.items()},
        "cg_ridge": fitted(fx.ridge2, lambda ts: fit_cg(ts, l2=L2, max_iter=2)),
        "fista_prox_l2": fitted(
            fx.event2,
            lambda ts: fit_fista(
                ts, l1=0.002, l2=L2, max_iter=3, lipschitz=0.5, l2_in_prox=True
            ),
            ("grad_norm_sq",),
        ),
        "fista_smooth_l2": fitted(
            fx.event2,
            lambda ts: fit_fista(ts, l1=0.002, l2=L2, max_iter=3, lipschitz=0.5),
            ("grad_norm_sq",),
        ),
        "admm_ridge": fitted(
            fx.ridge2, lambda ts: fit_admm(ts, SQUARED, l2=L2, max_iter=3, inner=20, rho=0.1)
        ),
        "admm_logistic": on_set(fx.event2, _admm_logistic),
        "dane_logistic": on_set(fx.event2, _dane),
        "dane_path": fitted(
            fx.event_small, lambda ts: fit_dane(ts, l2=0.05, max_iter=2, inner=2, rate=0.7)
        ),
        "dane_path_line_search": fitted(
            fx.event_small,
            lambda ts: fit_dane(ts, l2=0.05, max_iter=2, inner=2, rate=0.7, line_search=True),
        ),
        "dane_path_streamed": fitted(
            fx.event_small,
            lambda ts: fit_dane(ts, l2=0.05, max_iter=2, inner=2, rate=0.7, streamed=True),
        ),
        "admm_logistic_path": fitted(
            fx.event_small,
            lambda ts: fit_admm(ts, LOGISTIC, l2=0.05, max_iter=3, inner=2, rate=0.7, rho=0.1),
        ),
        "admm_logistic_path_streamed": fitted(
            fx.event_small,
            lambda ts: fit_admm(
                ts, LOGISTIC, l2=0.05, max_iter=3, inner=2, rate=0.7, rho=0.1, streamed=True
            ),
        ),
        "model_average_logistic_path": on_set(fx.event_small, _averaged_path(False)),
        "model_average_logistic_path_streamed": on_set(fx.event_small, _averaged_path(True)),
        "newton_logistic_warm_start": fitted(
            fx.event_small,
            lambda ts: fit_newton(
                ts, LOGISTIC, l2=0.05, max_iter=1, inner=3, rate=0.7, start="average"
            ),
        ),
        "newton_logistic_fixed_step": fitted(
            fx.logit2, lambda ts: fit_newton(ts, LOGISTIC, l2=L2, max_iter=3, line_search=False)
        ),
        "model_average_ridge": on_set(fx.ridge2, _average(SQUARED, L2, 7)),
        "model_average_logistic": on_set(
            fx.event2, _average(LOGISTIC, 0.1, 5, inner=20, rate=2.0)
        ),
        "grouped_enet_ls": on_set(fx.ridge2, _grouped),
        "grouped_enet_dual": lambda *a: _grouped_dual(F.col("l_returnflag"), 0.05, tol=1e-14)(*a),
        "grouped_enet_dual_ill_conditioned": lambda *a: _grouped_dual(
            small_group(), 2e-4, False, tol=1e-12, epochs=3000
        )(*a),
        "grouped_enet_dual_in_place": lambda *a: _grouped_dual(
            F.col("l_returnflag"), 0.05, group_bytes=0
        )(*a),
        "history_with_holdout": history_with_holdout,
        "sweep_momentum_gd": on_set(fx.logit2, _sweep),
        "preset_ridge": preset_ridge,
        "sweep_batched": on_set(fx.logit2, _sweep_batched),
        "score_rows": score_rows,
        "score_zero_one": score_zero_one,
        "score_mse": score_mse,
        "weight_sparsity": on_set(fx.emb, _sparsity),
    }
