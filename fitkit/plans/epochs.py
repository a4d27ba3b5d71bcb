"""Variance-reduced stochastic gradient for shards that no task can hold: one epoch is two passes.

The rows of a shard lie in one task in a seeded order, cut into blocks; a task reads them as a
stream and never holds more than one.  An epoch first sums the slope of every shard at its
anchor, then walks through the batches.  Between passes the solvers' state is a keyed table in
the shared folder, one row a shard, so a lost executor costs one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import scores
from fitkit.operators.blocks import PARTIAL_SCHEMA, Block, fold_partials, iter_blocks, partial_batch
from fitkit.operators.lockstep import ASK_BYTES
from fitkit.operators.losses import Loss
from fitkit.operators.shards import SVRG_BATCH
from fitkit.operators.training_set import TrainingSet
from fitkit.session import TableChain

#: ``w`` is where the shard stands, ``slope`` its sum of slopes at ``w`` once a pass has taken it, and
#: ``shift`` the linear term of its problem.
STATE_SCHEMA = "shard INT, s BIGINT, w BINARY, slope BINARY, shift BINARY"


def streams(ts: TrainingSet, streamed: bool) -> bool:
    """Whether shards are walked as streams: asked for, or a shard fits no task and may not be split."""
    return streamed or (ts.has_oversized_shard and not ts.split_shards)


def in_epochs(ts: TrainingSet, seed: int) -> DataFrame:
    """The blocks that epochs read: whole batches in a seeded order."""
    return ts.in_order(seed, SVRG_BATCH)


def _state_batch(shard: int, s: int, *vectors: np.ndarray | None) -> pa.RecordBatch:
    cells = [pa.array([None if v is None else v.tobytes()], pa.binary()) for v in vectors]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([s], pa.int64()), *cells],
        ["shard", "s", "w", "slope", "shift"],
    )


def _cells(batch: pa.RecordBatch, name: str) -> list[np.ndarray | None]:
    column = batch.column(batch.schema.names.index(name))
    return [np.frombuffer(c.as_buffer(), np.float64) if c.is_valid else None for c in column]


def batch_step(
    w: np.ndarray, anchor: np.ndarray, full: np.ndarray, x: np.ndarray, y: np.ndarray, loss: Loss, rate, ridge, weight
) -> np.ndarray:
    """One variance-reduced step on a batch; ``full`` is the gradient at the anchor without the ridge."""
    change = loss.slope(x @ w, y) - loss.slope(x @ anchor, y)
    return w - rate * (weight * (change @ x) / len(y) + full + ridge * w)


def run_epochs(
    ts: TrainingSet,
    blocks: DataFrame,
    loss: Loss,
    state: DataFrame,
    *,
    passes: int,
    rate: float,
    ridge: float,
    weight: Callable[[int], float] = lambda s: 1.0,
    shift: Callable[[np.ndarray, np.ndarray, int], np.ndarray] | None = None,
) -> tuple[DataFrame, TableChain]:
    """Run every shard's epochs; gives the final state and the chain that holds it, to be closed.

    ``state`` holds ``shard, s, w, slope, shift``.  Shard ``i`` minimises ``weight(s) * mean(loss) + 0.5 *
    ridge * |v|^2 + <shift, v>`` from its ``w``.  Where ``shift`` is given, a null shift is set by
    ``shift(w, slope sum at w, s)`` after the first pass.
    """
    spark, d, shape = ts.spark, ts.d, ts.shape

    def shards(batches):
        """Blocks with the state of their shard, shard by shard."""
        for batch in batches:
            w, slope, moved = (_cells(batch, n) for n in ("w", "slope", "shift"))
            sizes = batch.column(batch.schema.names.index("all")).to_pylist()
            for i, b in enumerate(iter_blocks(iter([batch]), shape)):
                yield b, sizes[i], w[i], slope[i], moved[i]

    def measure(batches):
        """The sum of slopes at ``w`` of every shard."""
        now, total = None, None
        for b, s, w, _, moved in shards(batches):
            if now is None or now[0] != b.shard:
                if now is not None:
                    yield leave(now, total)
                now, total = (b.shard, s, w, moved), np.zeros(d)
            total += loss.slope(scores(b.x, w), b.y) @ b.x
        if now is not None:
            yield leave(now, total)

    def leave(now, total):
        shard, s, w, moved = now
        if moved is None and shift is not None:
            moved = shift(w, total, s)
        return _state_batch(shard, s, w, total, moved)

    def walk(batches):
        """One walk through the batches of every shard, from its anchor."""
        now, v = None, None
        for b, s, anchor, slope, moved in shards(batches):
            if now is None or now[0] != b.shard:
                if now is not None:
                    yield _state_batch(now[0], now[1], v, None, now[2])
                now, v = (b.shard, s, moved), anchor
            full = weight(s) * slope / s + (0.0 if moved is None else moved)
            for at in range(0, len(b.y), SVRG_BATCH):
                part = slice(at, at + SVRG_BATCH)
                v = batch_step(v, anchor, full, b.x[part], b.y[part], loss, rate, ridge, weight(s))
        if now is not None:
            yield _state_batch(now[0], now[1], v, None, now[2])

    chain = TableChain(spark, "epochs")
    state = chain.put(state)
    # The vectors that are out with the tasks at once are bounded: more shards take turns.
    turns = max(1, math.ceil(state.count() * 24 * d / ASK_BYTES))
    turn = F.pmod(F.xxhash64("shard"), F.lit(turns))

    def go(kernel, state):
        out = None
        for k in range(turns):
            some = state.filter(turn == k) if turns > 1 else state
            # "s" of a block is its own row count.
            mine = some.select("shard", F.col("s").alias("all"), "w", "slope", "shift")
            done = blocks.join(F.broadcast(mine), "shard").mapInArrow(kernel, STATE_SCHEMA)
            out = done if out is None else out.unionAll(done)
        return chain.put(out)

    with ts.block_batches():
        for _ in range(passes):
            state = go(walk, go(measure, state))
    return state, chain


def start_state(blocks: DataFrame, w: np.ndarray, shift: np.ndarray | None) -> DataFrame:
    """Every shard at ``w``; a null shift is set after the first pass."""

    def rows(batches):
        for batch in batches:
            for shard, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _state_batch(shard, s, w, None, shift)

    sizes = blocks.groupBy("shard").agg(F.sum("s").cast("bigint").alias("s"))
    return sizes.mapInArrow(rows, STATE_SCHEMA)


def fold_state(state: DataFrame, length: int, term: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """``sum(term(s, w))`` over shards."""

    def kernel(batches):
        total = np.zeros(length)
        for batch in batches:
            sizes = batch.column(batch.schema.names.index("s")).to_pylist()
            for s, w in zip(sizes, _cells(batch, "w")):
                total += term(s, w)
        yield partial_batch(total)

    return fold_partials(state.mapInArrow(kernel, PARTIAL_SCHEMA), np.add, length, None)


def svrg_in_order(b: Block, loss: Loss, start, *, passes, rate, ridge, shift, loss_weight=1.0) -> np.ndarray:
    """The same epochs on a shard that is at hand, its rows in the order given; what tests compare with."""
    w, s = start.copy(), len(b.y)
    for _ in range(passes):
        anchor = w
        full = loss_weight * (loss.slope(b.x @ anchor, b.y) @ b.x) / s + shift
        for at in range(0, s, SVRG_BATCH):
            part = slice(at, at + SVRG_BATCH)
            w = batch_step(w, anchor, full, b.x[part], b.y[part], loss, rate, ridge, loss_weight)
    return w
