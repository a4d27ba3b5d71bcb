"""Per-shard statistics and per-shard solves.

The solvers here are small numpy helpers that run inside tasks; Spark decides which
rows form a shard, moves them, and adds up the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import scores
from fitkit.operators.blocks import (
    PARTIAL_SCHEMA,
    Block,
    Shape,
    fold_partials,
    iter_blocks,
    partial_batch,
    task_number,
)
from fitkit.operators.losses import Loss, shrink

STATS_SCHEMA = "shard INT, part INT, s BIGINT, stats ARRAY<DOUBLE>"
STATS_HOLD_BYTES = 64 << 20
SVRG_BATCH = 128  # samples per stochastic step (fixed value)


# ---- per-shard statistics ----------------------------------------------------


def native_stats(flat: DataFrame, d: int, score: Column, loss: Loss) -> DataFrame:
    """Statistics by ``groupBy(shard).agg`` on unrolled columns (no Python)."""
    xs = [F.col(f"x{j}") for j in range(d)]
    t, y = F.col("t"), F.col("y")
    scored = (
        flat.withColumn("t", score)
        .withColumn("k", loss.curvature_col(t, y))
        .withColumn("c", loss.slope_col(t, y))
    )
    upper = {
        (i, j): F.sum(F.col("k") * xs[i] * xs[j]).alias(f"h{i}_{j}")
        for i in range(d)
        for j in range(i, d)
    }
    sums = scored.groupBy("shard").agg(
        F.count("*").alias("s"),
        *upper.values(),
        *[F.sum(F.col("c") * xs[j]).alias(f"g{j}") for j in range(d)],
        F.sum(loss.value_col(t, y)).alias("value"),
        F.sum(loss.mistake_col(t, y)).alias("error"),
    )
    entries = [f"h{min(i, j)}_{max(i, j)}" for i in range(d) for j in range(d)]
    entries += [f"g{j}" for j in range(d)] + ["value", "error"]
    return sums.select(
        "shard", F.lit(0).alias("part"), "s", F.array(*[F.col(e) for e in entries]).alias("stats")
    )


def block_stats(b: Block, w: np.ndarray, loss: Loss) -> np.ndarray:
    t = scores(b.x, w)
    h = (b.x * loss.curvature(t, b.y)[:, None]).T @ b.x
    tail = [loss.value(t, b.y).sum(), loss.mistake(t, b.y).sum()]
    return np.concatenate([h.ravel(), loss.slope(t, b.y) @ b.x, tail])


def split_stats(stats: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """``(matrix, slope, loss, error)`` of one statistics vector."""
    return stats[: d * d].reshape(d, d), stats[d * d : d * d + d], stats[-2], stats[-1]


def _stats_batch(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    shard, part, s, stats = zip(*rows)
    values = pa.array(np.concatenate(stats), pa.float64())
    offsets = pa.array(np.cumsum([0] + [len(v) for v in stats]), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard, pa.int32()),
            pa.array(part, pa.int32()),
            pa.array(s, pa.int64()),
            pa.ListArray.from_arrays(offsets, values),
        ],
        ["shard", "part", "s", "stats"],
    )


def iter_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for batch in batches:
        names = batch.schema.names
        shard = batch.column(names.index("shard")).to_pylist()
        s = batch.column(names.index("s")).to_pylist()
        stats = batch.column(names.index("stats"))
        for i in range(batch.num_rows):
            yield shard[i], s[i], stats[i].values.to_numpy(zero_copy_only=False)


def gathered_stats(gathered: DataFrame, shape: Shape, w: np.ndarray, loss: Loss) -> DataFrame:
    """Statistics where every shard already lies in one task: no shuffle."""

    def kernel(batches):
        shard, s, total = None, 0, None
        for b in iter_blocks(batches, shape):
            stats = block_stats(b, w, loss)
            if shard == b.shard:
                s, total = s + len(b.y), total + stats
                continue
            if shard is not None:
                yield _stats_batch([(shard, 0, s, total)])
            shard, s, total = b.shard, len(b.y), stats
        if shard is not None:
            yield _stats_batch([(shard, 0, s, total)])

    return gathered.mapInArrow(kernel, STATS_SCHEMA)


def merged_stats(
    blocks: DataFrame, shape: Shape, n_tasks: int, w: np.ndarray, loss: Loss
) -> DataFrame:
    """Statistics of shards spread over many tasks: partial sums, then one or two merges.

    Each merge streams, holding one vector per shard.  With many tasks the first
    merge is salted by the sending task, so no reducer receives all partials of a
    shard.
    """
    d = len(w)
    hold = max(1, STATS_HOLD_BYTES // (8 * (d * d + d + 2)))

    def flush(held: dict, part: int):
        if held:
            yield _stats_batch([(k, part, s, v) for k, (s, v) in sorted(held.items())])
            held.clear()

    def partials(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        part = task_number()
        for b in iter_blocks(batches, shape):
            stats = block_stats(b, w, loss)
            s, v = held.get(b.shard, (0, 0.0))
            held[b.shard] = (s + len(b.y), v + stats)
            if len(held) >= hold:
                yield from flush(held, part)
        yield from flush(held, part)

    return merge_stats(blocks.mapInArrow(partials, STATS_SCHEMA), n_tasks)


def merge_stats(partials: DataFrame, n_tasks: int) -> DataFrame:
    """Sum keyed partial vectors by shard, salted by the sending task where many tasks send."""

    def merge(batches):
        # Input is sorted by shard, so one running sum is enough.
        shard, s, total, part = None, 0, None, 0
        for k, rows, v in iter_stats(batches):
            if shard == k:
                s, total = s + rows, total + v
                continue
            if shard is not None:
                yield _stats_batch([(shard, part, s, total)])
            shard, s, total = k, rows, v.copy()
        if shard is not None:
            yield _stats_batch([(shard, part, s, total)])

    def merged(df: DataFrame, *keys) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions("shard").mapInArrow(merge, STATS_SCHEMA)

    out = partials
    if n_tasks > 64:
        salt = F.pmod(F.col("part"), F.lit(int(n_tasks**0.5)))
        out = merged(out, F.col("shard"), salt)
    return merged(out, F.col("shard"))


# ---- small local solvers (run inside tasks) -------------------------------------


def conjugate_gradient(
    apply: Callable[[np.ndarray], np.ndarray],
    b: np.ndarray,
    steps: int,
    *,
    start: np.ndarray | None = None,
    tol: float = 1e-24,
) -> np.ndarray:
    """At most ``steps`` conjugate-gradient steps on a positive definite system.

    Pure: neither the operator nor the start vector is changed, and the tolerance
    (relative, squared) never drifts between calls.
    """
    v = np.zeros_like(b) if start is None else start.copy()
    r = b - apply(v) if start is not None else b.copy()
    p, rr = r.copy(), float(r @ r)
    floor = tol * max(float(b @ b), np.finfo(float).tiny)
    for _ in range(steps):
        if rr <= floor:
            break
        ap = apply(p)
        alpha = rr / float(p @ ap)
        v = v + alpha * p
        r = r - alpha * ap
        rr, old = float(r @ r), rr
        p = r + (rr / old) * p
    return v


def solve_matrix(a: np.ndarray, b: np.ndarray, steps: int, start=None) -> np.ndarray:
    """``steps`` CG steps on an explicit matrix; a direct solve once CG would be exact."""
    if steps >= len(b):
        try:
            return np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(a, b, rcond=None)[0]
    return conjugate_gradient(lambda p: a @ p, b, steps, start=start)


def elastic_net_quadratic(
    a: np.ndarray, b: np.ndarray, l1: float, *, start=None, sweeps: int = 1000, tol: float = 1e-14
) -> np.ndarray:
    """Minimise ``0.5 v'Av - b'v + l1 |v|_1`` by cyclic coordinate descent."""
    v = np.zeros_like(b) if start is None else start.astype(float).copy()
    av = a @ v
    diagonal = np.diag(a)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if diagonal[j] <= 0.0:
                continue
            new = shrink(b[j] - av[j] + diagonal[j] * v[j], l1) / diagonal[j]
            step = new - v[j]
            if step != 0.0:
                av += step * a[:, j]
                v[j] = new
                moved = max(moved, abs(step))
        if moved <= tol * max(1.0, float(np.abs(v).max(initial=0.0))):
            break
    return v


def elastic_net_rows(
    x: np.ndarray,
    weights: np.ndarray,
    l2: float,
    b: np.ndarray,
    l1: float,
    *,
    start: np.ndarray,
    sweeps: int,
    tol: float = 1e-14,
) -> np.ndarray:
    """The same problem with ``A = X' diag(weights) X + l2 I`` kept as rows, never formed."""
    v = start.copy()
    columns = np.asfortranarray(x)
    diagonal = weights @ (x * x) + l2
    score = x @ v
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            if diagonal[j] <= 0.0:
                continue
            pull = b[j] - (weights * score) @ columns[:, j] - l2 * v[j] + diagonal[j] * v[j]
            new = shrink(pull, l1) / diagonal[j]
            step = new - v[j]
            if step != 0.0:
                score += step * columns[:, j]
                v[j] = new
                moved = max(moved, abs(step))
        if moved <= tol * max(1.0, float(np.abs(v).max(initial=0.0))):
            break
    return v


def svrg(
    b: Block,
    loss: Loss,
    start: np.ndarray,
    *,
    passes: int,
    rate: float,
    ridge: float,
    shift: np.ndarray,
    loss_weight: float = 1.0,
    seed: tuple[int, ...],
) -> np.ndarray:
    """Variance-reduced stochastic gradient on one shard.

    Minimises ``loss_weight * mean(loss) + 0.5 * ridge * |w|^2 + <shift, w>``.  The
    order of samples is a seeded permutation of the id order.  Batches hold
    ``min(128, s)`` samples and the last, shorter one is used too.
    """
    s = len(b.y)
    order = np.random.default_rng([abs(v) for v in seed]).permutation(s)
    x, y = b.x[order], b.y[order]
    size = min(SVRG_BATCH, s)
    starts = range(0, s, size)
    w = start.copy()
    for _ in range(passes):
        anchor = w.copy()
        anchor_slope = loss.slope(x @ anchor, y)
        full = loss_weight * (anchor_slope @ x) / s + shift
        for i in starts:
            xb, yb = x[i : i + size], y[i : i + size]
            change = loss.slope(xb @ w, yb) - anchor_slope[i : i + size]
            w = w - rate * (loss_weight * (change @ xb) / len(yb) + full + ridge * w)
    return w


# ---- sums of local answers ----------------------------------------------------


def forms_matrix(s: int, d: int, q: int, limit: int) -> bool:
    """Whether forming the weighted Gram matrix of ``s`` rows beats ``q`` matrix-free steps."""
    return d <= limit and 4 * q * s >= (s + q) * d


def sum_over_stats(
    stats: DataFrame,
    length: int,
    n_tasks: int | None,
    term: Callable[[int, int, np.ndarray], np.ndarray],
) -> np.ndarray:
    """``sum(term(shard, s, stats))`` over per-shard statistics rows."""

    def kernel(batches):
        total = np.zeros(length)
        for shard, s, v in iter_stats(batches):
            total += term(shard, s, v)
        yield partial_batch(total)

    return fold_partials(stats.mapInArrow(kernel, PARTIAL_SCHEMA), np.add, length, n_tasks)
