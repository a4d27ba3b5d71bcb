"""Packed row blocks and vector sums over them.

A block row holds up to a few MB of samples as raw float64 buffers, so numpy reads
them from an Arrow batch without copying and one BLAS call covers the block.
Blocks are cut inside the map task: a shuffle, where one is needed at all, moves
blocks and not rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import column_matrix

BLOCK_SCHEMA = "shard INT, s INT, odd INT, pos INT, ids BINARY, y BINARY, x BINARY"
PARTIAL_SCHEMA = "part INT, v BINARY"
MERGE_ABOVE = 5_000_000  # doubles sent to the driver before a merge level is added


class Block(NamedTuple):
    shard: int
    ids: np.ndarray
    y: np.ndarray
    x: np.ndarray


@dataclass(frozen=True)
class Shape:
    """Width of the stored features, and the map applied when a block is read, if any."""

    width: int
    feature_map: object = None

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from a flat buffer to the feature matrix, made once per task."""
        if self.feature_map is None:
            return lambda flat: flat.reshape(-1, self.width)
        apply = self.feature_map.bind()
        return lambda flat: apply(flat.reshape(-1, self.width))


def _block_batch(shard: int, ids, y, x) -> pa.RecordBatch:
    ids, y, x = (np.concatenate(a) if len(a) > 1 else a[0] for a in (ids, y, x))
    odd = int((np.abs(y) != 1.0).sum())
    columns = [
        pa.array([shard], pa.int32()),
        pa.array([len(y)], pa.int32()),
        pa.array([odd], pa.int32()),
        pa.array([int((y > 0).sum())], pa.int32()),
        *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, y, x)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "s", "odd", "pos", "ids", "y", "x"])


def pack_blocks(
    df: DataFrame,
    d: int,
    *,
    block_bytes: int,
    row_bytes: int,
    feature_map=None,
) -> DataFrame:
    """``(shard, id, y, x)`` rows to block rows, within each map task.

    What one task holds is bounded by ``4 * block_bytes`` whatever the number of
    shards: when the buffers reach that, the largest are emitted early.  A row
    counts as ``row_bytes``, its size once all feature maps are applied.
    ``feature_map.bind()`` gives the function that widens an ``(s, d)`` matrix.
    """
    hold = 4 * block_bytes

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}
        mapped = feature_map.bind() if feature_map is not None else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if batch.column(2).null_count:
                raise ValueError("a label is null")
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            y = batch.column(2).to_numpy(zero_copy_only=False)
            x = column_matrix(batch.column(3), d)
            if mapped is not None:
                x = mapped(x)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for rows in np.split(order, cuts):
                k = int(shard[rows[0]])
                buffers = held.setdefault(k, [[], [], []])
                for buffer, part in zip(buffers, (ids, y, x)):
                    buffer.append(part[rows])
                sizes[k] = sizes.get(k, 0) + row_bytes * len(rows)
                if sizes[k] >= block_bytes:
                    sizes.pop(k)
                    yield _block_batch(k, *held.pop(k))
            while sum(sizes.values()) >= hold:
                k = max(sizes, key=sizes.get)
                sizes.pop(k)
                yield _block_batch(k, *held.pop(k))
        for k in sorted(held):
            yield _block_batch(k, *held[k])

    return df.select("shard", "id", "y", "x").mapInArrow(kernel, BLOCK_SCHEMA)


def pack_in_order(df: DataFrame, d: int, rows: int, feature_map=None) -> DataFrame:
    """``(shard, id, y, x)`` rows, sorted by shard, to blocks of ``rows`` rows in the order they come."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = feature_map.bind() if feature_map is not None else None
        shard, held, count = None, [], 0

        def cut(least: int):
            nonlocal held, count
            while count >= least:
                ids, y, x = (np.concatenate(c) for c in zip(*held))
                yield _block_batch(shard, [ids[:rows]], [y[:rows]], [x[:rows]])
                held, count = [(ids[rows:], y[rows:], x[rows:])], max(0, count - rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column(2).null_count:
                raise ValueError("a label is null")
            key, ids, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = column_matrix(batch.column(3), d)
            x = mapped(x) if mapped is not None else x
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if shard != int(key[a]):
                    yield from cut(1)
                    shard, held, count = int(key[a]), [], 0
                held.append((ids[a:b], y[a:b], x[a:b]))
                count += int(b - a)
                yield from cut(rows)
        yield from cut(1)

    return df.select("shard", "id", "y", "x").mapInArrow(kernel, BLOCK_SCHEMA)


def iter_blocks(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[Block]:
    """Blocks of a stream of Arrow batches, as views on the Arrow buffers."""
    read = shape.reader()
    for batch in batches:
        names = batch.schema.names
        shard, ids, y, x = (batch.column(names.index(n)) for n in ("shard", "ids", "y", "x"))
        for i in range(batch.num_rows):
            yield Block(
                shard[i].as_py(),
                np.frombuffer(ids[i].as_buffer(), np.int64),
                np.frombuffer(y[i].as_buffer(), np.float64),
                read(np.frombuffer(x[i].as_buffer(), np.float64)),
            )


def join_blocks(parts: list[Block]) -> Block:
    """One block from the blocks of a shard, rows ordered by id.

    The order makes seeded solvers independent of arrival order.  Blocks that are
    in order already, and single blocks, are not copied again.
    """
    if len(parts) == 1:
        ids, y, x = parts[0][1:]
    else:
        ids = np.concatenate([p.ids for p in parts])
        place = np.arange(len(ids))
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, place[order] = ids[order], np.arange(len(ids))
        # Rows go to their places at once: one copy beside the parts.
        y, x = np.empty(len(ids)), np.empty((len(ids), parts[0].x.shape[1]))
        at = 0
        for p in parts:
            to = place[at : at + len(p.y)]
            y[to], x[to] = p.y, p.x
            at += len(p.y)
    if (ids[1:] < ids[:-1]).any():
        order = np.argsort(ids, kind="stable")
        ids, y, x = ids[order], y[order], x[order]
    return Block(parts[0].shard, ids, y, x)


def iter_shards(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[Block]:
    """Whole shards, one at a time, from blocks that arrive grouped by shard."""
    for parts in _grouped(iter_blocks(batches, shape)):
        whole = join_blocks(parts)
        parts.clear()  # the parts go before the shard is worked on
        yield whole


def _grouped(blocks: Iterator[Block]) -> Iterator[list[Block]]:
    parts: list[Block] = []
    for block in blocks:
        if parts and parts[0].shard != block.shard:
            yield parts
            parts = []
        parts.append(block)
    if parts:
        yield parts


def order_blocks(packed: DataFrame, width: int, rows: int) -> DataFrame:
    """Sort each partition by shard; rewrite each shard in id order, ``rows`` per block."""

    def kernel(batches):
        for shard in iter_shards(batches, Shape(width)):
            for i in range(0, len(shard.y), rows):
                part = slice(i, i + rows)
                yield _block_batch(shard.shard, [shard.ids[part]], [shard.y[part]], [shard.x[part]])

    return packed.sortWithinPartitions("shard").mapInArrow(kernel, BLOCK_SCHEMA)


def task_number() -> int:
    task = TaskContext.get()
    return task.partitionId() if task else 0


def partial_batch(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([task_number()], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["part", "v"]
    )


def _fold(arrays: Iterator[np.ndarray], combine) -> np.ndarray | None:
    total = None
    for a in arrays:
        total = a.copy() if total is None else combine(total, a)
    return total


def fold_partials(partials: DataFrame, combine, length: int, n_tasks: int | None) -> np.ndarray:
    """Combine one partial vector per task into one vector on the driver.

    Few or short partials go straight to the driver.  Otherwise about
    ``sqrt(tasks)`` reducers combine them first, so the driver receives the square
    root of the volume.  ``n_tasks=None`` means unknown and takes the safe path.
    """
    if n_tasks is None or n_tasks * length > MERGE_ABOVE:
        reducers = max(2, math.isqrt(n_tasks or 1024))

        def merge(batches):
            total = _fold(
                (np.frombuffer(v.as_buffer(), np.float64) for b in batches for v in b.column(1)),
                combine,
            )
            if total is not None:
                yield partial_batch(total)

        partials = partials.repartition(
            reducers, F.pmod(F.col("part"), F.lit(reducers))
        ).mapInArrow(merge, PARTIAL_SCHEMA)
    rows = partials.select("part", "v").collect()
    rows.sort(key=lambda r: r["part"])
    total = _fold((np.frombuffer(r["v"], np.float64) for r in rows), combine)
    if total is None:
        raise ValueError("no rows")
    return total


def fold_rows(df: DataFrame, partial, combine, length: int) -> np.ndarray:
    """Fold one vector per Arrow batch, ``partial(batch)``, over a whole DataFrame."""

    def kernel(batches):
        total = _fold((partial(b) for b in batches if b.num_rows), combine)
        if total is not None:
            yield partial_batch(total)

    return fold_partials(df.mapInArrow(kernel, PARTIAL_SCHEMA), combine, length, None)


def sum_over_blocks(
    blocks: DataFrame,
    shape: Shape,
    length: int,
    n_tasks: int,
    term: Callable[[Block], np.ndarray],
    *,
    whole_shards: bool = False,
) -> np.ndarray:
    """``sum(term(block))``; with ``whole_shards`` each term sees one complete shard."""
    stream = iter_shards if whole_shards else iter_blocks

    def kernel(batches):
        total = np.zeros(length)
        for block in stream(batches, shape):
            total += term(block)
        yield partial_batch(total)

    return fold_partials(blocks.mapInArrow(kernel, PARTIAL_SCHEMA), np.add, length, n_tasks)
