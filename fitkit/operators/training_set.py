"""A prepared training table and the sums every trainer is built from.

Two physical forms, chosen by feature width and loss:

* native (squared loss, ``d <= native_limit``): features are unrolled into scalar
  columns and cached; each sum is one ``agg`` that whole-stage codegen runs in the
  JVM, with map-side partial aggregation, so a hot shard is never moved or collected.
* blocks: rows are packed into blocks and each sum is one Arrow kernel pass.  Also
  the faster form for narrow logistic data, whose cost is ``exp`` and ``log``:
  numpy evaluates those several times faster than the JVM's strict math.

A third form, whole shards gathered into tasks, is built only for solvers that
need all rows of a shard at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitkit.functions.vectors import scores, weighted_sum
from fitkit.operators import lockstep, shards
from fitkit.operators.blocks import Block, Shape, order_blocks, pack_blocks, pack_in_order, sum_over_blocks
from fitkit.operators.losses import SQUARED, Loss, Penalty
from fitkit.session import arrow_rows

# Up to this source width a feature map is cheaper to recompute than to read back
# from the cache, and the cache stays as small as the source.
MAP_ON_READ_WIDTH = 64
SPREAD_ABOVE = 20_000  # rows below which an uneven layout does not matter
BROADCAST_SLOTS = 1_000_000  # slot labels (one integer each) that may be broadcast
TASKS_PER_CORE = 4  # up to so many shards a core each have a task of their own
TRACKED = -(1 << 31)  # marks blocks of a held-out table that shares the passes
MAX_STATE_BYTES = 1 << 30  # one weight vector shipped to tasks


@dataclass(frozen=True)
class Evaluation:
    """Mean-scaled sums at one ``w``: objective, error, gradient of the smooth part."""

    objective: float
    error: float
    gradient: np.ndarray
    held_error: float | None = None  # of a tracked table, measured in the same pass

    @property
    def grad_norm_sq(self) -> float:
        return float(self.gradient @ self.gradient)


def as_evaluation(
    sums: np.ndarray, n: int, w: np.ndarray, penalty: Penalty, held: np.ndarray | None = None
) -> Evaluation:
    """Turn ``[gradient sums.., loss sum, error sum]`` over ``n`` rows into penalised means.

    ``held`` has the error sum and the rows of a tracked table.
    """
    return Evaluation(
        float(sums[-2] / n + penalty.value(w)),
        float(sums[-1] / n),
        sums[:-2] / n + penalty.gradient(w),
        float(held[0] / held[1]) if held is not None and held[1] else None,
    )


@dataclass(frozen=True)
class Profile:
    n: int
    d: int
    odd_labels: int
    positive_labels: int


class TrainingSet:
    """``(shard INT, id BIGINT, y DOUBLE, x ARRAY<DOUBLE>)`` made ready for fitting.

    ``shard`` may be absent for methods that do not use it.  ``id`` orders rows
    inside a shard; without one a content hash is used.  A shard stays a shard: methods
    that need its rows in one task refuse a shard over ``shard_bytes``, unless
    ``split_shards`` allows them to fit pieces of it, cut by id, as shards.
    A ``feature_map`` (such as ``RandomFourier``) is applied inside the kernels: on
    every read when the source is narrow, else once while blocks are packed.
    Use as a context manager, or call :meth:`close`, to release the caches.
    """

    def __init__(
        self,
        df: DataFrame,
        *,
        d: int | None = None,
        native_limit: int = 8,
        engine: str = "auto",
        block_bytes: int = 16 << 20,
        shard_bytes: int = 256 << 20,
        split_shards: bool = False,
        gram_limit: int = 2048,
        feature_map=None,
    ):
        self.spark = df.sparkSession
        y = F.col("y").cast("double")
        x = F.col("x").cast("array<double>")
        shard = F.col("shard").cast("int") if "shard" in df.columns else F.lit(0)
        row_id = F.col("id").cast("bigint") if "id" in df.columns else F.xxhash64("y", "x")
        self.rows = df.select(
            shard.alias("shard"), row_id.alias("id"), y.alias("y"), x.alias("x")
        )
        if not d:
            first = self.rows.select(F.size("x")).first()
            if first is None:
                raise ValueError("the training table is empty")
            d = first[0]
        self.source_width = d
        self.feature_map = feature_map
        self.d = self.source_width if feature_map is None else feature_map.size
        mapped_on_read = feature_map is not None and self.source_width <= MAP_ON_READ_WIDTH
        self.pack_map = None if mapped_on_read else feature_map
        self.stored_width = self.source_width if self.pack_map is None else self.d
        self.shape = Shape(self.stored_width, feature_map if mapped_on_read else None)
        if 8 * self.d > MAX_STATE_BYTES:
            raise ValueError(f"a weight vector of {self.d} doubles is too large to ship to tasks")
        if engine not in ("auto", "native", "blocks"):
            raise ValueError(f"unknown engine {engine!r}")
        if engine == "native" and feature_map is not None:
            raise ValueError("a feature map needs the block form")
        self.engine = engine
        self.narrow = feature_map is None and self.d <= native_limit
        self.block_bytes = block_bytes
        self.shard_bytes = shard_bytes
        self.split_shards = split_shards
        self.gram_limit = gram_limit
        self._held: list[DataFrame] = []
        self._ordered: tuple[int, DataFrame] | None = None
        self._tracked: DataFrame | None = None

    def __enter__(self) -> TrainingSet:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()
        self._ordered = self._tracked = None
        for name in (
            "flat",
            "blocks",
            "pure_blocks",
            "gathered",
            "joinable",
            "profile",
            "slots",
            "labels",
            "gather_tasks",
            "m",
        ):
            self.__dict__.pop(name, None)

    def hold(self, df: DataFrame) -> DataFrame:
        df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(df)
        return df

    def release(self, df: DataFrame) -> None:
        df.unpersist()
        self._held = [held for held in self._held if held is not df]

    def is_native(self, loss: Loss) -> bool:
        """Whether sums of this loss run as JVM aggregations."""
        if self.engine == "auto":
            return self.narrow and not loss.labels_are_signs
        return self.engine == "native"

    def prepare(self, loss: Loss) -> TrainingSet:
        """Build and cache the form this loss uses, unless one is cached already."""
        if self.is_native(loss):
            self.flat
        else:
            self._held_blocks()
        return self

    # ---- physical forms -------------------------------------------------

    def _scalars(self, rows: DataFrame) -> DataFrame:
        """Scalar columns ``shard, y, x0..``; a null or an array of another width is an error."""

        def present(column: Column, what: str) -> Column:
            return F.coalesce(column, F.raise_error(F.lit(what)).cast("double"))

        wrong = F.lit(f"feature arrays differ in width: expected {self.d}")
        xs = [
            present(F.get(F.col("x"), F.lit(j)), f"a feature is null or missing: x{j}")
            for j in range(self.d)
        ]
        xs[0] = F.when(F.size("x") == self.d, xs[0]).otherwise(F.raise_error(wrong).cast("double"))
        named = [x.alias(f"x{j}") for j, x in enumerate(xs)]
        return rows.select("shard", present(F.col("y"), "a label is null").alias("y"), *named)

    @cached_property
    def flat(self) -> DataFrame:
        """The scalar columns, cached."""
        odd = F.when(F.abs("y") == 1.0, 0).otherwise(1)
        positive = F.when(F.col("y") > 0, 1).otherwise(0)
        return self._hold_even(self._scalars, F.lit(1), odd, positive)[0]

    @cached_property
    def blocks(self) -> DataFrame:
        """Blocks cut where the rows already are: no shuffle, shards mixed."""
        with self.batches():
            out, self._block_tasks = self._hold_even(
                lambda rows: self._pack(rows.withColumn("shard", F.lit(0)))
            )
        return out

    @cached_property
    def pure_blocks(self) -> DataFrame:
        """Blocks that hold one shard each, still cut where the rows are."""
        with self.batches():
            out, self._pure_tasks = self._hold_even(self._pack)
        return out

    def _hold_even(self, build, rows="s", odd="odd", positive="pos") -> tuple[DataFrame, int]:
        """Cache ``build(rows)``; if its partitions leave the cluster idle, spread rows first.

        An iterative fit passes over the cache many times, so one unsplittable file
        or a few fat partitions would set the pace of every pass.  With more
        partitions than cores, the normal case for large inputs, nothing is moved.
        The job that fills the cache also takes the profile.
        """
        cores = self.spark.sparkContext.defaultParallelism
        out = self.hold(build(self.rows))
        measured = out.select(
            F.spark_partition_id().alias("p"), *self._measures(rows, odd, positive)
        )
        row = self._take_profile(measured.groupBy("p"), F.max("p").alias("last"))
        if row["n"] >= SPREAD_ABOVE and row["largest"] > 2 * math.ceil(row["n"] / cores):
            self.release(out)
            out = self.hold(build(self.rows.repartition(cores)))
            out.count()  # fill the cache here, under the batch size of the caller
            return out, cores
        return out, row["last"] + 1

    def _pack(self, rows: DataFrame) -> DataFrame:
        return pack_blocks(
            rows,
            self.source_width,
            block_bytes=self.block_bytes,
            row_bytes=self.row_bytes,
            feature_map=self.pack_map,
        )

    @cached_property
    def slots(self) -> list[tuple[int, int, int, int]]:
        """``(shard, first slot, pieces, rows)`` per shard.

        One piece per shard is the rule.  With ``split_shards`` a shard whose rows would
        not fit the per-task budget is cut into equal pieces by a hash of the row id, and
        each piece acts as a shard of its own; no row is left out.
        """
        found = self.rows.groupBy("shard").count().collect()
        if any(r["shard"] is None for r in found):
            raise ValueError("a shard is null")
        counts = sorted((r["shard"], r["count"]) for r in found)
        if not counts:
            raise ValueError("the training table is empty")
        out, first = [], 0
        for shard, rows in counts:
            pieces = math.ceil(rows / self.task_rows) if self.split_shards else 1
            out.append((shard, first, pieces, rows))
            first += pieces
        return out

    @cached_property
    def m(self) -> int:
        """Number of shards in the table."""
        return len(self.slots)

    @property
    def n_slots(self) -> int:
        return self.slots[-1][1] + self.slots[-1][2]

    @cached_property
    def gather_tasks(self) -> int:
        """Tasks that gathered shards lie in: one each while they are few, else several shards a task.

        A task reads its shards one after the other and holds one at a time, so many small shards share
        a task and only bytes and cores decide how many tasks there are.
        """
        cores = self.spark.sparkContext.defaultParallelism
        total = 8 * self.d * sum(rows for *_, rows in self.slots)
        return min(self.n_slots, max(TASKS_PER_CORE * cores, math.ceil(total / self.shard_bytes)))

    @property
    def row_bytes(self) -> int:
        """A row in a block, at its widest: features, label and id."""
        return 8 * (max(self.d, self.source_width) + 2)

    @property
    def task_rows(self) -> int:
        """Rows of one shard that a task may hold."""
        return max(1, self.shard_bytes // (8 * self.d))

    @property
    def largest_shard(self) -> int:
        return max(rows for *_, rows in self.slots)

    @property
    def has_oversized_shard(self) -> bool:
        return self.largest_shard > self.task_rows

    @cached_property
    def labels(self) -> list[int]:
        """One integer per slot; where every slot has a task, such that hash partitioning gives it one.

        Plain shard numbers collide under hash partitioning and leave some tasks
        with several shards and others with none, which sets the pace of every
        iteration.  Labels are free to choose, so they are picked by the partition
        Spark's own hash assigns them.  The partitioning stays an ordinary hash
        partitioning on ``shard``, which joins on that column reuse.
        """
        m = self.n_slots
        if self.gather_tasks < m:
            return list(range(m))
        reach = int(m * (math.log(m) + 10)) + 1
        while True:
            home = F.pmod(F.hash(F.col("id").cast("int")), F.lit(m)).alias("p")
            found = self.spark.range(reach).groupBy(home).agg(F.min("id").alias("label"))
            by_home = {r["p"]: r["label"] for r in found.collect()}
            if len(by_home) == m:
                return [by_home[p] for p in range(m)]
            reach *= 2

    def slot_table(self) -> DataFrame:
        """``(shard, rows, labels ARRAY<INT>)``: the labels of the pieces of each shard."""
        values = [(s, n, self.labels[f : f + p]) for s, f, p, n in self.slots]
        return self.spark.createDataFrame(values, "shard INT, rows BIGINT, labels ARRAY<INT>")

    @cached_property
    def gathered(self) -> DataFrame:
        """All blocks of a shard in one task, consecutive, ordered by id, cached.

        ``shard`` holds the slot label here.  Rows are packed into blocks before the
        shuffle, and blocks are ordered once, after it.
        """
        return self._gather(lambda packed: order_blocks(packed, self.stored_width, self._rows_per_block))

    @cached_property
    def joinable(self) -> DataFrame:
        """The same, hash partitioned and sorted by ``shard`` in Spark's eyes.

        A join on ``shard`` then moves only the other side.  Blocks of a shard are
        not in id order; the reader orders them.
        """
        return self._gather(lambda packed: packed.sortWithinPartitions("shard"))

    def _gather(self, arrange) -> DataFrame:
        if self.has_oversized_shard and not self.split_shards:
            wanted = math.ceil(self.m * self.largest_shard / self.task_rows)
            raise ValueError(
                f"a shard has {self.largest_shard} rows and a task holds {self.task_rows}: use about {wanted} "
                "shards, a larger shard_bytes, split_shards=True to fit pieces of it as shards, or a solver in lockstep"
            )
        piece = F.pmod(F.xxhash64("id"), F.size("labels"))
        label = F.get("labels", piece.cast("int"))
        slots = self.slot_table()
        if self.n_slots <= BROADCAST_SLOTS:
            slots = F.broadcast(slots)
        rows = self.rows.join(slots, "shard").withColumn("shard", label)
        with self.batches():
            out = self.hold(arrange(self._pack(rows).repartition(self.gather_tasks, "shard")))
            measured = out.select("shard", *self._measures("s", "odd", "pos"))
            largest = self._take_profile(measured.groupBy("shard"))["largest"]
        if self.has_oversized_shard and 8 * self.d * largest > 2 * self.shard_bytes:
            raise ValueError(
                f"a shard keeps {largest} rows after splitting by id; give rows unique ids"
            )
        return out

    @property
    def _rows_per_block(self) -> int:
        return max(1, self.block_bytes // self.row_bytes)

    def batches(self):
        """Arrow batch limit for jobs over this table."""
        return arrow_rows(self.spark, 8 * max(self.source_width, 1), self.block_bytes)

    def block_batches(self):
        """Arrow batch limit for jobs over packed blocks: one full block, or many small ones."""
        return arrow_rows(self.spark, 1, self.block_bytes // 2)

    @staticmethod
    def _measures(rows, odd, positive) -> list[Column]:
        columns = [F.col(c) if isinstance(c, str) else c for c in (rows, odd, positive)]
        return [c.alias(name) for c, name in zip(columns, ("r", "odd", "pos"))]

    def _take_profile(self, groups, *extra: Column):
        """Sum the measures, keep them as the profile, and return them with the largest group."""
        row = (
            groups.agg(*[F.sum(c).alias(c) for c in ("r", "odd", "pos")])
            .agg(
                F.max("r").alias("largest"),
                F.sum("r").alias("n"),
                F.sum("odd").alias("odd"),
                F.sum("pos").alias("pos"),
                *extra,
            )
            .first()
        )
        if not row["n"]:
            raise ValueError("the training table is empty")
        self.__dict__["profile"] = Profile(row["n"], self.d, row["odd"], row["pos"])
        return row

    def _held_blocks(self) -> tuple[DataFrame, int | None]:
        """The block form already cached, whichever it is, so data is cached once."""
        for name in ("gathered", "joinable"):
            if name in self.__dict__:
                return getattr(self, name), self.gather_tasks
        if self._ordered is not None:
            return self._ordered[1], None
        if "pure_blocks" in self.__dict__:
            return self.pure_blocks, self._pure_tasks
        return self.blocks, self._block_tasks

    # ---- profile ----------------------------------------------------------

    @cached_property
    def profile(self) -> Profile:
        """Row count, width and label domain of the whole table."""
        self.prepare(SQUARED)  # whichever form is cached first takes the profile
        return self.__dict__["profile"]

    @property
    def n(self) -> int:
        return self.profile.n

    def check_labels(self, loss: Loss) -> None:
        """Sign labels are required over the whole table; a one-class shard is legal."""
        if not loss.labels_are_signs:
            return
        self.prepare(loss)
        p = self.profile
        if p.odd_labels:
            raise ValueError(f"{p.odd_labels} labels are not -1 or +1")
        if p.positive_labels in (0, p.n):
            raise ValueError("all labels are equal")

    # ---- sums -------------------------------------------------------------

    def _xs(self) -> list[Column]:
        return [F.col(f"x{j}") for j in range(self.d)]

    def _score(self, w: np.ndarray) -> Column:
        return weighted_sum(self._xs(), w)

    def _native_sum(self, df: DataFrame, terms: list[Column]) -> np.ndarray:
        sums = [F.sum(t).alias(f"v{i}") for i, t in enumerate(terms)]
        return np.array(df.agg(*sums).first(), dtype=np.float64)

    def _block_sum(self, length: int, term: Callable[[Block], np.ndarray]) -> np.ndarray:
        blocks, tasks = self._held_blocks()
        with self.block_batches():
            return sum_over_blocks(blocks, self.shape, length, tasks, term)

    def track(self, other: TrainingSet, loss: Loss) -> bool:
        """Let evaluations of this loss measure the error on ``other`` too, in the same pass.

        Only where sums run over blocks of the same shape; gives whether it does.
        """
        if self.is_native(loss) or other.shape != self.shape or other.d != self.d:
            return False
        self._tracked = other._held_blocks()[0].withColumn("shard", F.lit(TRACKED))
        return True

    def untrack(self) -> None:
        self._tracked = None

    def _tracked_sum(
        self, length: int, term: Callable[[Block], np.ndarray], w: np.ndarray, loss: Loss
    ) -> tuple[np.ndarray, np.ndarray | None]:
        """A sum over the blocks, with the error sum and the rows of a tracked table at ``w``."""
        if self._tracked is None:
            return self._block_sum(length, term), None

        def both(b: Block) -> np.ndarray:
            if b.shard != TRACKED:
                return np.append(term(b), [0.0, 0.0])
            out = np.zeros(length + 2)
            out[-2:] = loss.mistake(scores(b.x, w), b.y).sum(), len(b.y)
            return out

        blocks, tasks = self._held_blocks()
        with self.block_batches():
            every = blocks.unionAll(self._tracked.select(*blocks.columns))
            total = sum_over_blocks(every, self.shape, length + 2, tasks and 2 * tasks, both)
        return total[:-2], total[-2:]

    def evaluate(self, w: np.ndarray, loss: Loss, penalty: Penalty) -> Evaluation:
        """Gradient, objective and training error at ``w`` in one pass."""
        return self.evaluate_all([w], loss, penalty)[0]

    def evaluate_all(
        self, points: list[np.ndarray], loss: Loss, penalty: Penalty
    ) -> list[Evaluation]:
        """The same at several points, still in one pass."""
        d, y, held = self.d, F.col("y"), None
        if self.is_native(loss):
            scored, terms = self.flat, []
            for i, w in enumerate(points):
                scored = scored.withColumn(f"t{i}", self._score(w))
            for i in range(len(points)):
                scored = scored.withColumn(f"c{i}", loss.slope_col(F.col(f"t{i}"), y))
                t = F.col(f"t{i}")
                terms += [F.col(f"c{i}") * x for x in self._xs()]
                terms += [loss.value_col(t, y), loss.mistake_col(t, y)]
            sums = self._native_sum(scored, terms)
        else:

            def term(b: Block) -> np.ndarray:
                out = []
                for w in points:
                    t = scores(b.x, w)
                    out.append(loss.slope(t, b.y) @ b.x)
                    out.append([loss.value(t, b.y).sum(), loss.mistake(t, b.y).sum()])
                return np.concatenate(out)

            sums, held = self._tracked_sum(len(points) * (d + 2), term, points[0], loss)
        parts = np.split(sums, len(points))
        found = [as_evaluation(v, self.n, w, penalty) for v, w in zip(parts, points)]
        if held is not None:
            found[0] = as_evaluation(parts[0], self.n, points[0], penalty, held)
        return found

    def evaluate_once(self, w: np.ndarray, loss: Loss, penalty: Penalty, n: int) -> Evaluation:
        """:meth:`evaluate` over ``n`` rows; a table that is not cached yet is read and not cached."""
        if not self.is_native(loss) or "flat" in self.__dict__:
            return self.evaluate(w, loss, penalty)
        scored = self._scalars(self.rows).withColumn("t", self._score(w))
        t, y = F.col("t"), F.col("y")
        scored = scored.withColumn("c", loss.slope_col(t, y))
        terms = [F.col("c") * x for x in self._xs()] + [loss.value_col(t, y), loss.mistake_col(t, y)]
        return as_evaluation(self._native_sum(scored, terms), n, w, penalty)

    def mean_error(self, w: np.ndarray, loss: Loss) -> float:
        """Share of mistakes (or mean squared residual) at ``w``, without the gradient."""
        if self.is_native(loss):
            error = loss.mistake_col(self._score(w), F.col("y"))
            return float(self._native_sum(self.flat, [error])[0] / self.n)
        total = self._block_sum(1, lambda b: np.array([loss.mistake(scores(b.x, w), b.y).sum()]))
        return float(total[0] / self.n)

    def line(
        self,
        w: np.ndarray,
        p: np.ndarray,
        etas: np.ndarray,
        loss: Loss,
        penalty: Penalty,
        *,
        slopes: bool = False,
    ) -> tuple[np.ndarray, np.ndarray | None, Evaluation]:
        """Objectives at ``w - eta p`` for all steps, in one pass over two score vectors.

        Also returns ``<p, gradient(w - eta p)>`` on request, and the full
        evaluation at ``w - etas[0] p``: when that first step is the one taken, the
        next iteration has its gradient without another pass.
        """
        if loss is SQUARED:
            return self._quadratic_line(w, p, etas, penalty, slopes)
        d, k, y, held = self.d, len(etas), F.col("y"), None
        if self.is_native(loss):
            t, q = F.col("t"), F.col("q")
            scored = self.flat.withColumn("t", self._score(w)).withColumn("q", self._score(p))
            at = [t - F.lit(float(e)) * q for e in etas]
            with_slope = scored.withColumn("c", loss.slope_col(at[0], y))
            terms = [loss.value_col(a, y) for a in at]
            terms += [F.col("c") * x for x in self._xs()] + [loss.mistake_col(at[0], y)]
            if slopes:
                terms += [loss.slope_col(a, y) * q for a in at]
            sums = self._native_sum(with_slope, terms)
        else:

            def term(b: Block) -> np.ndarray:
                t, q = scores(b.x, w), scores(b.x, p)
                ats = [t - e * q for e in etas]
                values = [loss.value(a, b.y).sum() for a in ats]
                first = loss.slope(ats[0], b.y)
                tail = [loss.slope(a, b.y) @ q for a in ats] if slopes else []
                return np.concatenate(
                    [values, first @ b.x, [loss.mistake(ats[0], b.y).sum()], tail]
                )

            length = k + d + 1 + (k if slopes else 0)
            sums, held = self._tracked_sum(length, term, w - etas[0] * p, loss)
        n = self.n
        points = [w - e * p for e in etas]
        objectives = sums[:k] / n + np.array([penalty.value(v) for v in points])
        first = np.concatenate([sums[k : k + d], [sums[0], sums[k + d]]])
        directional = None
        if slopes:
            directional = sums[k + d + 1 :] / n + np.array(
                [p @ penalty.gradient(v) for v in points]
            )
        return objectives, directional, as_evaluation(first, n, points[0], penalty, held)

    def _quadratic_line(self, w, p, etas, penalty: Penalty, slopes: bool):
        """The same for the squared loss, which is an exact parabola along the line.

        Three sums of residual ``r`` and ``q = <x, p>`` give every step at once.
        """
        d, n, first, held = self.d, self.n, float(etas[0]), None
        if self.is_native(SQUARED):
            scored = self.flat.select(
                *self._xs(), (self._score(w) - F.col("y")).alias("r"), self._score(p).alias("q")
            )
            moved = scored.withColumn("c", F.col("r") - F.lit(first) * F.col("q"))
            terms = [F.col(a) * F.col(b) for a, b in (("r", "r"), ("r", "q"), ("q", "q"))]
            sums = self._native_sum(moved, [F.col("c") * x for x in self._xs()] + terms)
        else:

            def term(b: Block) -> np.ndarray:
                r, q = scores(b.x, w) - b.y, scores(b.x, p)
                return np.concatenate([(r - first * q) @ b.x, [r @ r, r @ q, q @ q]])

            sums, held = self._tracked_sum(d + 3, term, w - first * p, SQUARED)
        rr, rq, qq = sums[d:]
        squared = np.maximum(rr - 2.0 * etas * rq + etas**2 * qq, 0.0)
        points = [w - e * p for e in etas]
        objectives = 0.5 * squared / n + np.array([penalty.value(v) for v in points])
        directional = None
        if slopes:
            directional = (rq - etas * qq) / n + np.array([p @ penalty.gradient(v) for v in points])
        tail = [0.5 * squared[0], squared[0]]
        full = as_evaluation(np.concatenate([sums[:d], tail]), n, points[0], penalty, held)
        return objectives, directional, full

    def moments(self) -> np.ndarray:
        """``X y`` (a plain sum)."""
        if self.is_native(SQUARED):
            return self._native_sum(self.flat, [x * F.col("y") for x in self._xs()])
        return self._block_sum(self.d, lambda b: b.y @ b.x)

    def gram_apply(self, p: np.ndarray) -> np.ndarray:
        """``X (X' p)`` (a plain sum)."""
        if self.is_native(SQUARED):
            scored = self.flat.withColumn("t", self._score(p))
            return self._native_sum(scored, [x * F.col("t") for x in self._xs()])
        return self._block_sum(self.d, lambda b: scores(b.x, p) @ b.x)

    def shard_stats(self, w: np.ndarray, loss: Loss) -> DataFrame:
        """Per shard: ``(shard, s, stats)``, stats = curvature matrix, slope, loss, error.

        Sums are merged with partial aggregation, so any shard size is exact.  With
        the squared loss at ``w = 0`` they hold the Gram matrix, ``-X y`` and half
        the squared label norm.
        """
        if self.is_native(loss):
            once = "flat" not in self.__dict__ and not w.any()  # one pass needs no cache
            flat = self._scalars(self.rows) if once else self.flat
            return shards.native_stats(flat, self.d, self._score(w), loss)
        if self.d > self.gram_limit:
            raise ValueError(f"a {self.d} x {self.d} matrix per shard is over the limit; use shard_tiles")
        if "gathered" in self.__dict__:
            return shards.gathered_stats(self.gathered, self.shape, w, loss)
        return shards.merged_stats(self.pure_blocks, self.shape, self._pure_tasks, w, loss)

    # ---- shards that no task holds ------------------------------------------

    def shard_sizes(self) -> DataFrame:
        """``shard, s``: rows of every shard, from the blocks that hold one shard each."""
        return self.pure_blocks.groupBy("shard").agg(F.sum("s").cast("bigint").alias("s"))

    def in_order(self, seed: int, multiple: int) -> DataFrame:
        """Blocks of every shard in a seeded order of its rows, a multiple of rows each, cached.

        A shard lies in one task, which reads it as a stream, block by block; the order is that of a
        hash of the row id, whatever the layout.  Every row moves once.
        """
        if self._ordered is None or self._ordered[0] != seed:
            rows = max(1, self._rows_per_block // multiple) * multiple
            order = (F.xxhash64(F.lit(seed), F.col("id")), "id", "y", "x")
            dealt = self.rows.repartition("shard").sortWithinPartitions("shard", *order)
            with self.batches():
                out = self.hold(pack_in_order(dealt, self.source_width, rows, self.pack_map))
                self._take_profile(out.select("shard", *self._measures("s", "odd", "pos")).groupBy("shard"))
            if self._ordered is not None:
                self.release(self._ordered[1])
            self._ordered = (seed, out)
        return self._ordered[1]

    def shard_products(self, w: np.ndarray, loss: Loss) -> lockstep.Product:
        """Products with every shard's curvature matrix at ``w``, from rows where they lie."""
        return lockstep.rows_product(self.pure_blocks, self.shape, self._pure_tasks, w, loss)

    def shard_tiles(self, w: np.ndarray, loss: Loss, tile: int = 512) -> DataFrame:
        """``shard, i, j, s, tile``: every shard's curvature matrix at ``w`` as upper tiles, any width."""
        blocks = self.pure_blocks
        return lockstep.tiled_matrices(blocks, self.shape, self._pure_tasks, w, loss, tile)
