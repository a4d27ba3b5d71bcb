"""Per-shard solves in lockstep: for shards that no task holds, at any width.

All shards run their solver at the same time.  A solver asks for the product of its
shard's curvature matrix with one vector; a pass over the data, where it lies, answers
the questions of all shards with partial sums by shard; every solver then moves on.  The
solvers' state is a keyed table, one row a shard: vectors go out to the tasks joined by
shard, sums come back by shard, and no row of the data moves.

The matrix can be rows (:func:`rows_product`) or a table of tiles (:func:`tiles_product`).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import scores
from fitkit.operators.blocks import PARTIAL_SCHEMA, Shape, fold_partials, iter_blocks, partial_batch, task_number
from fitkit.operators.losses import Loss, shrink
from fitkit.operators.shards import STATS_SCHEMA, _stats_batch, iter_stats, merge_stats
from fitkit.session import TableChain

STATE_SCHEMA = "shard INT, s BIGINT, ask BINARY, solver BINARY"
TILE_SCHEMA = "shard INT, i INT, j INT, part INT, s BIGINT, tile BINARY"
# Bytes of vectors that may be out with the tasks at once; more shards take turns in groups.
ASK_BYTES = 256 << 20
# Bytes of partial sums or tiles that a task holds.
HOLD_BYTES = 128 << 20

Product = Callable[[DataFrame], DataFrame]


# ---- solvers: plain state machines that ask for products -------------------------


class ConjugateGradient:
    """At most ``steps`` CG steps on ``A v = b`` from zero; the same arithmetic as the in-task form."""

    def __init__(self, b: np.ndarray, steps: int, tol: float = 1e-24):
        self.v, self.r, self.p = np.zeros_like(b), b.copy(), b.copy()
        self.rr = float(b @ b)
        self.floor = tol * max(self.rr, np.finfo(float).tiny)
        self.left = steps

    def ask(self) -> np.ndarray | None:
        return self.p if self.left > 0 and self.rr > self.floor else None

    def tell(self, ap: np.ndarray) -> None:
        alpha = self.rr / float(self.p @ ap)
        self.v = self.v + alpha * self.p
        self.r = self.r - alpha * ap
        old, self.rr = self.rr, float(self.r @ self.r)
        self.p = self.r + (self.rr / old) * self.p
        self.left -= 1

    def answer(self) -> np.ndarray:
        return self.v


class ElasticNet:
    """Minimise ``<g, v - w> + 0.5 (v - w)' A (v - w) + l1 |v|_1`` from ``w``; answers ``w - v``.

    A proximal gradient step finds which coordinates are zero and the signs of the others;
    CG then minimises over those coordinates, stopping where one would change its sign; and
    so on until no subgradient is left.  At most ``steps`` products.
    """

    def __init__(self, w: np.ndarray, g: np.ndarray, l1: float, steps: int, tol: float = 1e-22):
        self.w, self.v, self.l1, self.left = w, w.copy(), l1, steps
        # With u = A (v - w) kept at hand, the gradient of the smooth part is g + u.
        self.g, self.u = g, np.zeros_like(g)
        self.bound = 0.0
        self.floor = tol * max(1.0, float(g @ g))
        self.phase, self.z = "probe", g.copy()
        if self._stationary():
            self.phase = "done"

    def _stationary(self) -> bool:
        slope = self.g + self.u
        sub = np.where(self.v != 0.0, slope + self.l1 * np.sign(self.v), shrink(slope, self.l1))
        return float(sub @ sub) <= self.floor

    def ask(self) -> np.ndarray | None:
        return None if self.phase == "done" or self.left <= 0 else self.z

    def _proximal(self) -> None:
        if self._stationary():
            self.phase = "done"
            return
        new = shrink(self.v - (self.g + self.u) / self.bound, self.l1 / self.bound)
        self.phase, self.z = "proximal", new - self.v

    def _face(self) -> None:
        """Start CG over the coordinates that are not zero."""
        self.sign = np.sign(self.v)
        free = self.sign != 0.0
        self.r = np.where(free, -(self.g + self.u + self.l1 * self.sign), 0.0)
        self.rr = float(self.r @ self.r)
        self.turns = int(free.sum())
        if self.rr <= self.floor:
            self._proximal()
        else:
            self.phase, self.z = "face", self.r.copy()

    def tell(self, az: np.ndarray) -> None:
        self.left -= 1
        z, curve = self.z, float(self.z @ az)
        if self.phase == "probe":
            self.bound = max(curve / float(z @ z), np.finfo(float).tiny)
            self._proximal()
        elif self.phase == "proximal":
            length = float(z @ z)
            if curve > self.bound * length * (1 + 1e-9):
                self.bound = max(1.5 * self.bound, 1.05 * curve / length)
                self._proximal()
                return
            self.v, self.u = self.v + z, self.u + az
            self._face()
        else:
            alpha = self.rr / curve
            against = z * self.sign < 0.0
            reach = np.where(against, -self.v / np.where(against, z, 1.0), np.inf)
            first = float(reach.min(initial=np.inf))
            if alpha >= first:
                hit = reach <= first
                self.v, self.u = self.v + first * z, self.u + first * az
                self.v[hit] = 0.0
                # The product belongs to the unclipped move; what clipping changed is rounding.
                self._proximal()
                return
            self.v, self.u = self.v + alpha * z, self.u + alpha * az
            free = self.sign != 0.0
            self.r = self.r - alpha * np.where(free, az, 0.0)
            old, self.rr = self.rr, float(self.r @ self.r)
            self.turns -= 1
            if self.rr <= self.floor or self.turns <= 0:
                self._proximal()
            else:
                self.z = self.r + (self.rr / old) * z

    def answer(self) -> np.ndarray:
        return self.w - self.v


# ---- products -----------------------------------------------------------------------


def _vector(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.float64)


class _Held:
    """Partial sums by shard inside one task; they leave when they weigh ``HOLD_BYTES``."""

    def __init__(self, d: int):
        self.most = max(1, HOLD_BYTES // (8 * d))
        self.part = task_number()
        self.sums: dict[int, tuple[int, np.ndarray]] = {}

    def add(self, shard: int, s: int, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, total = self.sums.get(shard, (0, 0.0))
        self.sums[shard] = (rows + s, total + v)
        if len(self.sums) >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.sums:
            yield _stats_batch([(k, self.part, s, v) for k, (s, v) in sorted(self.sums.items())])
            self.sums.clear()


def rows_product(blocks: DataFrame, shape: Shape, n_tasks: int, w: np.ndarray, loss: Loss) -> Product:
    """``X_i' K_i X_i z_i`` from rows: one pass over blocks that hold one shard each, ``K`` at ``w``."""
    d = len(w)

    def kernel(batches):
        held = _Held(d)
        for batch in batches:
            asks = batch.column(batch.schema.names.index("ask"))
            for ask, b in zip(asks, iter_blocks(iter([batch]), shape)):
                k = loss.curvature(scores(b.x, w), b.y)
                yield from held.add(b.shard, len(b.y), (k * (b.x @ _vector(ask))) @ b.x)
        yield from held.flush()

    def product(asks: DataFrame) -> DataFrame:
        return merge_stats(blocks.join(F.broadcast(asks), "shard").mapInArrow(kernel, STATS_SCHEMA), n_tasks)

    return product


def shard_sums(blocks: DataFrame, shape: Shape, n_tasks: int, length: int, term, vectors: DataFrame | None = None) -> DataFrame:
    """``shard, s, stats``: ``term(block, vector)`` summed by shard; ``vectors`` holds ``shard, ask``."""

    def kernel(batches):
        held = _Held(length)
        for batch in batches:
            names = batch.schema.names
            asks = batch.column(names.index("ask")) if "ask" in names else [None] * batch.num_rows
            for ask, b in zip(asks, iter_blocks(iter([batch]), shape)):
                yield from held.add(b.shard, len(b.y), term(b, None if ask is None else _vector(ask)))
        yield from held.flush()

    rows = blocks if vectors is None else blocks.join(F.broadcast(vectors), "shard")
    return merge_stats(rows.mapInArrow(kernel, STATS_SCHEMA), n_tasks).drop("part")


def tiles_product(tiles: DataFrame, d: int, tile: int, n_tasks: int) -> Product:
    """``G_i z_i`` from the upper tiles of the shard matrices."""

    def kernel(batches):
        held = _Held(d)
        for batch in batches:
            names = batch.schema.names
            shard, i, j, cells, asks = (batch.column(names.index(n)) for n in ("shard", "i", "j", "tile", "ask"))
            for k, a, b, cell, ask in zip(shard.to_pylist(), i.to_pylist(), j.to_pylist(), cells, asks):
                z, out = _vector(ask), np.zeros(d)
                rows, columns = slice(a * tile, (a + 1) * tile), slice(b * tile, (b + 1) * tile)
                m = _vector(cell).reshape(len(z[rows]), len(z[columns]))
                out[rows] += m @ z[columns]
                if a != b:
                    out[columns] += z[rows] @ m
                yield from held.add(k, 0, out)
        yield from held.flush()

    def product(asks: DataFrame) -> DataFrame:
        return merge_stats(tiles.join(F.broadcast(asks), "shard").mapInArrow(kernel, STATS_SCHEMA), n_tasks)

    return product


# ---- the loop -----------------------------------------------------------------------


def _state_batch(shard: int, s: int, solver) -> pa.RecordBatch:
    ask = solver.ask()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int32()),
            pa.array([s], pa.int64()),
            pa.array([None if ask is None else ask.tobytes()], pa.binary()),
            pa.array([pickle.dumps(vars(solver))], pa.binary()),
        ],
        ["shard", "s", "ask", "solver"],
    )


def _solvers(batch: pa.RecordBatch, kind: type):
    names = batch.schema.names
    for shard, s, cell in zip(*(batch.column(names.index(n)) for n in ("shard", "s", "solver"))):
        solver = kind.__new__(kind)
        solver.__dict__.update(pickle.loads(cell.as_py()))
        yield shard.as_py(), s.as_py(), solver


class Answers:
    """``shard, s, answer`` of a run in lockstep, in the shared folder until :meth:`close`."""

    def __init__(self, tables: list[DataFrame], chains: list[TableChain]):
        self.tables, self.chains = tables, chains

    def table(self) -> DataFrame:
        out = self.tables[0]
        for more in self.tables[1:]:
            out = out.unionAll(more)
        return out

    def close(self) -> None:
        for chain in self.chains:
            chain.close()


def answers_in_lockstep(sizes: DataFrame, d: int, l2: float, start: Callable, kind: type, product: Product) -> Answers:
    """Run every shard's solver to its end.

    ``sizes`` holds ``shard, s`` and optionally ``stats``, a vector of the shard.  Its solver is ``start(s,
    stats)``, an instance of ``kind``; its matrix is the mean over the shard's rows of what ``product``
    sums, plus ``l2`` on the diagonal.
    """
    spark = sizes.sparkSession
    # The vectors that are out at once weigh ASK_BYTES at most: more shards take turns.
    groups = math.ceil(sizes.count() * 8 * d / ASK_BYTES)
    tables, chains = [], []

    def first(batches):
        for batch in batches:
            vectors = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
            for shard, s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), vectors):
                v = None if v is None else v.values.to_numpy(zero_copy_only=False)
                yield _state_batch(shard, s, start(s, v))

    def advance(batches):
        for batch in batches:
            sums = batch.column(batch.schema.names.index("stats"))
            for (shard, s, solver), az in zip(_solvers(batch, kind), sums):
                if az.is_valid:
                    solver.tell(az.values.to_numpy(zero_copy_only=False) / s + l2 * solver.ask())
                yield _state_batch(shard, s, solver)

    def ends(batches):
        for batch in batches:
            for shard, s, solver in _solvers(batch, kind):
                yield _stats_batch([(shard, 0, s, solver.answer())])

    for group in range(max(1, groups)):
        mine = sizes
        if groups > 1:
            mine = sizes.filter(F.pmod(F.xxhash64("shard"), F.lit(groups)) == group)
        chain = TableChain(spark, "lockstep")
        columns = [c for c in ("shard", "s", "stats") if c in mine.columns]
        state = chain.put(mine.select(*columns).mapInArrow(first, STATE_SCHEMA))
        while not state.filter("ask IS NOT NULL").isEmpty():
            asks = state.filter("ask IS NOT NULL").select("shard", "ask")
            answers = product(asks).select("shard", "stats")
            state = chain.put(state.join(answers, "shard", "left").mapInArrow(advance, STATE_SCHEMA))
        tables.append(state.mapInArrow(ends, STATS_SCHEMA).select("shard", "s", F.col("stats").alias("answer")))
        chains.append(chain)
    return Answers(tables, chains)


def solve_in_lockstep(sizes: DataFrame, d: int, l2: float, start: Callable[[], object], kind: type, product: Product) -> np.ndarray:
    """``sum_i s_i v_i / sum_i s_i``, the row-weighted mean of the shards' answers from equal starts."""

    def fold(batches):
        out = np.zeros(d + 1)
        for batch in batches:
            for s, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                out += np.append(s * v.values.to_numpy(zero_copy_only=False), s)
        yield partial_batch(out)

    found = answers_in_lockstep(sizes, d, l2, lambda s, v: start(), kind, product)
    table = found.table().select("s", "answer")
    total = fold_partials(table.mapInArrow(fold, PARTIAL_SCHEMA), np.add, d + 1, None)
    found.close()
    return total[:-1] / total[-1]


# ---- tiles --------------------------------------------------------------------------


def tiled_matrices(blocks: DataFrame, shape: Shape, n_tasks: int, w: np.ndarray, loss: Loss, tile: int) -> DataFrame:
    """``shard, i, j, s, tile``: the upper tiles of ``X' K X`` of every shard, ``K`` at ``w``, summed.

    A task sums tiles while it reads its blocks shard by shard.  A matrix that is larger than
    ``HOLD_BYTES`` is made in bands of tile rows, one pass over the blocks each.  Tiles are summed
    by ``(shard, i, j)``, so a shard's matrix lies in as many tasks as it has tiles.
    """
    d = len(w)
    side = math.ceil(d / tile)
    heights = [min(tile, d - i * tile) * (d - i * tile) * 8 for i in range(side)]
    bands, size = [[]], 0
    for i, height in enumerate(heights):
        if bands[-1] and size + height > HOLD_BYTES:
            bands.append([])
            size = 0
        bands[-1].append(i)
        size += height

    def batch_of(rows) -> pa.RecordBatch:
        shard, i, j, part, s, m = zip(*rows)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array(c, type=k) for c, k in zip((shard, i, j, part, s), kinds)]
        columns.append(pa.array([np.ascontiguousarray(x).tobytes() for x in m], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["shard", "i", "j", "part", "s", "tile"])

    def partials(band: list[int]):
        first, last = band[0], band[-1]
        top = slice(first * tile, min(d, (last + 1) * tile))

        def kernel(batches):
            part, shard, s, total = task_number(), None, 0, None

            def leave():
                for i in band:
                    rows = slice(i * tile - top.start, (i + 1) * tile - top.start)
                    for j in range(i, side):
                        columns = slice(j * tile - top.start, (j + 1) * tile - top.start)
                        yield batch_of([(shard, i, j, part, s, total[rows, columns])])

            for b in iter_blocks(batches, shape):
                if shard is not None and shard != b.shard:
                    yield from leave()
                    s, total = 0, None
                shard = b.shard
                k = loss.curvature(scores(b.x, w), b.y)
                piece = (b.x[:, top] * k[:, None]).T @ b.x[:, top.start :]
                s += len(b.y)
                if total is None:
                    total = piece
                else:
                    total += piece
            if shard is not None:
                yield from leave()

        return kernel

    def merge(batches):
        key, s, total = None, 0, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in range(5)]
            for a, i, j, _, rows, cell in zip(*columns, batch.column(5)):
                if key != (a, i, j):
                    if key is not None:
                        yield batch_of([(*key, 0, s, total)])
                    key, s, total = (a, i, j), rows, _vector(cell).copy()
                else:
                    s, total = s + rows, total + _vector(cell)
        if key is not None:
            yield batch_of([(*key, 0, s, total)])

    def merged(df: DataFrame, *keys) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions("shard", "i", "j").mapInArrow(merge, TILE_SCHEMA)

    ordered = blocks.sortWithinPartitions("shard")
    out = None
    for band in bands:
        one = ordered.mapInArrow(partials(band), TILE_SCHEMA)
        out = one if out is None else out.unionAll(one)
    if n_tasks > 64:
        out = merged(out, F.col("shard"), F.col("i"), F.col("j"), F.pmod(F.col("part"), F.lit(int(n_tasks**0.5))))
    return merged(out, F.col("shard"), F.col("i"), F.col("j")).drop("part")
