"""One elastic-net least-squares fit per group by dual ascent, with a duality gap as certificate.

A group's problem is ``(1/2s) |X w - y|^2 + lam (0.5 |w|^2 + sigma |w|_1 - <w, tilt>)``.  Its dual has one
variable a row; ``w`` follows from them by a soft threshold.  Rows are taken in blocks: the dual
bound of a block is maximised exactly, one small linear system for all its rows.  Where a row's
squared norm is above ``10 lam s``, an accelerated proximal outer loop solves better conditioned problems
of the same form.  The gap between primal and dual value bounds how far a fit is from its optimum.

A group that fits a task is solved in one; the rows of a larger one stay where they are, and all such
groups are solved in lockstep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.functions.vectors import column_matrix
from fitkit.operators import lockstep
from fitkit.operators.losses import SQUARED, shrink
from fitkit.operators.training_set import TrainingSet

BLOCK_ROWS = 128
# A row norm beyond this many ``lam s`` calls for the outer loop, and its inner strength (fixed values).
ILL_CONDITIONED = 10.0
INNER_EPOCHS = 3


def primal_value(x, y, w, lam, sigma, tilt) -> float:
    fit = 0.5 * float(np.mean((x @ w - y) ** 2))
    return fit + lam * (0.5 * float(w @ w) + sigma * float(np.abs(w).sum()) - float(w @ tilt))


def dual_value(ay: float, aa: float, xa: np.ndarray, s: int, lam, sigma, tilt) -> float:
    """From ``<a, y>``, ``<a, a>`` and ``X' a`` of the dual variables."""
    w = shrink(xa / (lam * s) + tilt, sigma)
    return (ay - 0.5 * aa) / s - 0.5 * lam * float(w @ w)


class BlockDual:
    """Dual ascent over blocks of rows for one strength; ``alpha`` may be handed on to another one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, alpha: np.ndarray, lam: float, sigma: float):
        self.x, self.y, self.alpha, self.lam, self.sigma = x, y, alpha, lam, sigma
        s, d = x.shape
        self.scale = 1.0 / (lam * s)
        self.parts = [slice(i, i + BLOCK_ROWS) for i in range(0, s, BLOCK_ROWS)]
        # Narrow rows keep a d x d matrix a block, wide ones one as high as the block: never more than the rows.
        self.narrow = d < BLOCK_ROWS
        if self.narrow:
            self.solvers = np.empty((len(self.parts), d, d))
        else:
            self.solvers = [None] * len(self.parts)
        for i, part in enumerate(self.parts):
            k = (x[part].T @ x[part] if self.narrow else x[part] @ x[part].T) * self.scale
            self.solvers[i] = np.linalg.inv(k + np.eye(len(k)))
        self.v = x.T @ alpha * self.scale

    def solve(self, i: int, r: np.ndarray) -> np.ndarray:
        """``(1 + X X' scale)^-1 r`` for the rows of a block."""
        if not self.narrow:
            return self.solvers[i] @ r
        x = self.x[self.parts[i]]
        return r - x @ (self.solvers[i] @ (r @ x)) * self.scale

    def epoch(self, tilt: np.ndarray, order: np.ndarray) -> np.ndarray:
        for i in order:
            part = self.parts[i]
            w = shrink(self.v + tilt, self.sigma)
            step = self.solve(i, self.y[part] - self.alpha[part] - self.x[part] @ w)
            self.alpha[part] += step
            self.v = self.v + step @ self.x[part] * self.scale
        return shrink(self.v + tilt, self.sigma)


def dual_ascent(
    x: np.ndarray, y: np.ndarray, *, lam: float, sigma: float, tilt: np.ndarray, tol: float, epochs: int, seed: int = 0
) -> tuple[np.ndarray, float, float, int]:
    """``w``, its primal value, the duality gap and the epochs taken; ends at a gap of ``tol``."""
    s, draw = len(y), np.random.default_rng(seed)
    norm = float(np.einsum("ij,ij->i", x, x).max(initial=0.0))
    more = norm / (ILL_CONDITIONED * s) - lam if norm > ILL_CONDITIONED * lam * s else 0.0
    strength = lam + more
    dual = BlockDual(x, y, np.zeros(s), strength, lam * sigma / strength)
    w = ahead = np.zeros(x.shape[1])
    eta = np.sqrt(lam / (lam + 2.0 * more))
    best = (w, primal_value(x, y, w, lam, sigma, tilt), np.inf)
    taken = 0
    while taken < epochs:
        before = w
        pulled = (lam * tilt + more * ahead) / strength
        for _ in range(INNER_EPOCHS if more else 1):
            w = dual.epoch(pulled, draw.permutation(len(dual.parts)))
            taken += 1
        ahead = w + (1 - eta) / (1 + eta) * (w - before)
        value = primal_value(x, y, w, lam, sigma, tilt)
        # Two dual points: the variables as they stand, and the residual.
        bounds = [
            dual_value(float(a @ y), float(a @ a), x.T @ a, s, lam, sigma, tilt) for a in (dual.alpha, y - x @ w)
        ]
        gap = max(0.0, value - max(bounds))
        if gap < best[2]:
            best = (w, value, gap)
        if gap <= tol:
            break
    return *best, taken


def fit_groups_dual(
    df: DataFrame,
    key: str,
    *,
    lam: float,
    sigma: float = 0.0,
    tilt: np.ndarray | None = None,
    tol: float = 1e-10,
    epochs: int = 500,
    seed: int = 0,
    group_bytes: int = 256 << 20,
) -> DataFrame:
    """``key, s, w, objective, gap, epochs`` for each group of ``df`` (``key``, ``y``, ``x ARRAY<DOUBLE>``).

    The key may have any type that can be grouped; a null key is a group.  An empty table gives an empty
    result.  ``gap`` bounds the distance of ``objective`` to the optimum; a group that has not reached
    ``tol`` after ``epochs`` shows it there.  Groups that need more than ``group_bytes`` in a task (the rows,
    what arrives of them and the dual variables) are solved where their rows lie.
    """
    spark = df.sparkSession
    first = df.select(F.size("x")).first()
    d = first[0] if first else 0
    tilt = np.zeros(d) if tilt is None else np.asarray(tilt, dtype=np.float64)
    rows = df.select(F.col(key).alias("key"), F.col("y").cast("double").alias("y"), F.col("x").cast("array<double>").alias("x"))
    key_type = rows.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("s", T.LongType()),
            T.StructField("w", T.ArrayType(T.DoubleType())),
            T.StructField("objective", T.DoubleType()),
            T.StructField("gap", T.DoubleType()),
            T.StructField("epochs", T.LongType()),
        ]
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, xs, ys = None, [], []
        for batch in batches:  # only numbers are kept of what arrives
            if not batch.num_rows:
                continue
            if batch.column(1).null_count:
                raise ValueError("a label is null")
            if key is None:
                key = batch.column(0).take(pa.array([0]))
            xs.append(column_matrix(batch.column(2), d).copy())
            ys.append(batch.column(1).to_numpy(zero_copy_only=False).copy())
        x = np.concatenate(xs)
        xs.clear()
        y = np.concatenate(ys)
        ys.clear()
        w, value, gap, taken = dual_ascent(x, y, lam=lam, sigma=sigma, tilt=tilt, tol=tol, epochs=epochs, seed=seed)
        columns = [pa.array([v], type=t) for v, t in zip((len(y), w.tolist(), value, gap, taken), kinds)]
        yield pa.RecordBatch.from_arrays([key, *columns], ["key", "s", "w", "objective", "gap", "epochs"])

    kinds = (pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64())
    # A row in a task: its features, twice while they arrive, and y, alpha and passing vectors beside them.
    row_bytes = 8 * (2 * d + 6)
    # Groups that a task can't hold are few: the table has room for no more.
    large = [r[0] for r in rows.groupBy("key").count().filter(F.col("count") * row_bytes > group_bytes).select("key").collect()]
    if not large:
        return rows.groupBy("key").applyInArrow(solve, schema)
    named = spark.createDataFrame(
        [(k, i) for i, k in enumerate(large)], T.StructType([T.StructField("name", key_type), T.StructField("shard", T.IntegerType())])
    )
    marked = rows.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("name")), "left")
    small = marked.filter("shard IS NULL").select("key", "y", "x").groupBy("key").applyInArrow(solve, schema)
    there = _in_place(marked.filter("shard IS NOT NULL").select("shard", "y", "x"), lam, sigma, tilt, epochs)
    there = there.join(F.broadcast(named), "shard").select(F.col("name").alias("key"), "s", "w", "objective", "gap", "epochs")
    return small.unionByName(there)


def _in_place(rows: DataFrame, lam: float, sigma: float, tilt: np.ndarray, steps: int) -> DataFrame:
    """The same fits in lockstep, with the gap of the residual as dual point."""
    with TrainingSet(rows, engine="blocks") as ts:
        d, l1 = ts.d, lam * sigma
        blocks, shape, tasks = ts.pure_blocks, ts.shape, ts._pure_tasks
        with ts.block_batches():
            moments = lockstep.shard_sums(blocks, shape, tasks, d, lambda b, _: b.y @ b.x)

            def start(s, v):
                return lockstep.ElasticNet(np.zeros(d), -(v / s + lam * tilt), l1, steps)

            product = ts.shard_products(np.zeros(d), SQUARED)
            found = lockstep.answers_in_lockstep(moments, d, lam, start, lockstep.ElasticNet, product)

            def vectors(batches):
                for batch in batches:
                    # The solver answers how far its start, zero, is from the minimum.
                    cells = [(0.0 - v.values.to_numpy(zero_copy_only=False)).tobytes() for v in batch.column(1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["shard", "ask"])

            models = found.table().select("shard", "answer").mapInArrow(vectors, "shard INT, ask BINARY")

            def at(b, w):
                a = b.y - b.x @ w
                return np.concatenate([a @ b.x, [a @ b.y, a @ a]])

            sums = lockstep.shard_sums(blocks, shape, tasks, d + 2, at, models)

            def certify(batches):
                for batch in batches:
                    names = batch.schema.names
                    shard, s, stats, ask = (batch.column(names.index(n)) for n in ("shard", "s", "stats", "ask"))
                    out = []
                    for k, n, v, cell in zip(shard.to_pylist(), s.to_pylist(), stats, ask):
                        v, w = v.values.to_numpy(zero_copy_only=False), np.frombuffer(cell.as_buffer())
                        value = 0.5 * v[d + 1] / n + lam * (0.5 * w @ w + sigma * np.abs(w).sum() - w @ tilt)
                        gap = max(0.0, value - dual_value(v[d], v[d + 1], v[:d], n, lam, sigma, tilt))
                        out.append((k, n, w.tolist(), float(value), gap, None))
                    kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64())
                    columns = [pa.array([r[i] for r in out], type=t) for i, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "s", "w", "objective", "gap", "epochs"])

            schema = "shard INT, s BIGINT, w ARRAY<DOUBLE>, objective DOUBLE, gap DOUBLE, epochs BIGINT"
            done = sums.join(models, "shard").mapInArrow(certify, schema)
            # One row a large group; written, as the caches go.
            out = lockstep.TableChain(ts.spark, "groups").put(done)
        found.close()
    return out
