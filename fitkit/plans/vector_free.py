"""L-BFGS whose history never visits the driver.

The direction is a linear combination of the last steps, the last gradient differences and the
gradient, and its coefficients follow from the dot products of these vectors alone.  The vectors lie
in a table cut into chunks of coordinates; a pass over it adds up the dot products, the driver
runs the two loops on their small matrix, and another pass combines the chunks to the direction.
The driver holds a few vectors of the width of the model, whatever the length of the history.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.operators.blocks import PARTIAL_SCHEMA, fold_partials, partial_batch
from fitkit.operators.losses import Loss, Penalty
from fitkit.operators.training_set import TrainingSet
from fitkit.plans.gradient import CURVATURE_FLOOR
from fitkit.plans.local import starting_point
from fitkit.plans.loop import FitResult, Step, run
from fitkit.plans.steps import StopRule, step_table, wolfe
from fitkit.session import drop_path, scratch_path

CHUNK = 1 << 16
VECTOR_SCHEMA = "name INT, chunk INT, v BINARY"


class Vectors:
    """Named vectors in the shared folder, in chunks of ``chunk`` coordinates."""

    def __init__(self, spark, d: int, chunk: int):
        self.spark, self.d, self.chunk = spark, d, chunk
        self.root = scratch_path(spark, "vectors")
        self.tables: dict[int, DataFrame] = {}
        self.order: list[tuple[int, int]] = []  # (step, gradient difference), oldest first
        self.count = 0

    def rows(self, name: int, v: np.ndarray) -> DataFrame:
        cuts = range(0, self.d, self.chunk)
        values = [(name, i, v[at : at + self.chunk].tobytes()) for i, at in enumerate(cuts)]
        return self.spark.createDataFrame(values, VECTOR_SCHEMA)

    def add_pair(self, s: np.ndarray, y: np.ndarray, memory: int) -> None:
        """Keep a pair of vectors; beyond ``memory`` pairs the oldest goes."""
        names = (self.count, self.count + 1)
        self.count += 2
        for name, v in zip(names, (s, y)):
            path = f"{self.root}/{name}"
            self.rows(name, v).write.parquet(path)
            self.tables[name] = self.spark.read.schema(VECTOR_SCHEMA).parquet(path)
        self.order.append(names)
        if len(self.order) > memory:
            for name in self.order.pop(0):
                del self.tables[name]
                drop_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        drop_path(self.spark, self.root)

    def direction(self, g: np.ndarray) -> np.ndarray:
        """The quasi-Newton ascent direction at gradient ``g``."""
        if not self.order:
            return g.copy()
        names = [a for a, _ in self.order] + [b for _, b in self.order] + [-1]
        place = {name: i for i, name in enumerate(names)}
        size, d, chunk = len(names), self.d, self.chunk
        table = self.rows(-1, g)
        for name in names[:-1]:
            table = table.unionAll(self.tables[name])
        chunks = -(-d // chunk)
        table = table.repartition(min(chunks, 64), "chunk").sortWithinPartitions("chunk").persist()

        def grouped(batches):
            """``chunk, size x coordinates`` for every chunk."""
            now, found = None, None
            for batch in batches:
                for name, i, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    v = np.frombuffer(cell.as_buffer(), np.float64)
                    if i != now:
                        if now is not None:
                            yield now, found
                        now, found = i, np.zeros((size, len(v)))
                    found[place[name]] = v
            if now is not None:
                yield now, found

        def dots(batches):
            total = np.zeros((size, size))
            for _, b in grouped(batches):
                total += b @ b.T
            yield partial_batch(total.ravel())

        try:
            gram = fold_partials(table.mapInArrow(dots, PARTIAL_SCHEMA), np.add, size * size, chunks)
            weights = combine(gram.reshape(size, size))

            def combined(batches):
                for i, b in grouped(batches):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([0], pa.int32()), pa.array([i], pa.int32()), pa.array([(weights @ b).tobytes()], pa.binary())],
                        ["name", "chunk", "v"],
                    )

            out = np.empty(d)
            for r in table.mapInArrow(combined, VECTOR_SCHEMA).collect():  # one vector
                v = np.frombuffer(r["v"], np.float64)
                out[r["chunk"] * chunk : r["chunk"] * chunk + len(v)] = v
            return out
        finally:
            table.unpersist()


def combine(gram: np.ndarray) -> np.ndarray:
    """Coefficients of the direction from the dot products of steps, differences and gradient."""
    m = len(gram) // 2
    weights = np.zeros(len(gram))
    weights[-1] = 1.0
    kept = np.zeros(m)
    for i in reversed(range(m)):
        kept[i] = weights @ gram[:, i] / gram[i, m + i]
        weights[m + i] -= kept[i]
    weights *= gram[m - 1, 2 * m - 1] / gram[2 * m - 1, 2 * m - 1]
    for i in range(m):
        weights[i] += kept[i] - weights @ gram[:, m + i] / gram[i, m + i]
    return weights


def fit_lbfgs_vector_free(
    ts: TrainingSet,
    loss: Loss,
    *,
    l2: float,
    max_iter: int,
    memory: int = 10,
    chunk: int = CHUNK,
    start=None,
    inner: int = 20,
    rate: float = 1.0,
    seed: int = 0,
    **loop,
) -> FitResult:
    """:func:`fitkit.plans.gradient.fit_lbfgs` with its history in a table."""
    ts.prepare(loss).check_labels(loss)
    penalty, etas = Penalty(l2=l2), step_table(loss)
    loop.setdefault("stop", StopRule(grad_tol=1e-22 if loss.labels_are_signs else 1e-18))
    loop.setdefault("keep_path", False)
    vectors = Vectors(ts.spark, ts.d, chunk)
    last: list[np.ndarray] = []

    def step(t, w, ev):
        g = ev.gradient
        if last:
            s, y = w - last[0], g - last[1]
            if float(s @ y) > CURVATURE_FLOOR * float(y @ y):
                vectors.add_pair(s, y, memory)
        last[:] = [w, g]
        p = vectors.direction(g)
        values, slopes, full = ts.line(w, p, etas, loss, penalty, slopes=True)
        k = wolfe(etas, values, slopes, ev.objective, float(p @ g))
        return Step(w - etas[k] * p, float(etas[k]), full if k == 0 else None)

    try:
        w0 = starting_point(ts, start, loss, l2, inner=inner, rate=rate, seed=seed)
        return run(ts, loss, penalty, w0, step, max_iter=max_iter, **loop)
    finally:
        if vectors.count:
            vectors.close()
