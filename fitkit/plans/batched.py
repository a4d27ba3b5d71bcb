"""One pass for a whole grid: fits that need global sums only share every pass over the data.

Each member of a grid runs its own trainer in a thread of the driver and keeps its own step sizes and
stop rule.  Where the trainer asks its table for sums, it waits until every running member
has asked; one job then answers all.  In a block all score vectors are the columns of one matrix
product and all gradients of another, so a grid costs the passes of its longest member.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

from fitkit.functions.vectors import UNROLL_LIMIT, scores
from fitkit.operators.blocks import Block, sum_over_blocks
from fitkit.operators.losses import Loss, Penalty
from fitkit.operators.training_set import Evaluation, TrainingSet, as_evaluation
from fitkit.plans.loop import FitResult


@dataclass
class Ask:
    """Sums that one member wants.

    ``body(t, y)`` gets the scores along ``vectors``, one column each, and gives the columns whose
    products with the features are wanted and plain sums; ``finish(products, sums)`` makes the answer.
    """

    vectors: list[np.ndarray]
    columns: int
    sums: int
    body: Callable[[np.ndarray, np.ndarray], tuple[list[np.ndarray], list[float]]]
    finish: Callable[[np.ndarray, np.ndarray], object]


def ask_points(points: list[np.ndarray], n: int, loss: Loss, penalty: Penalty) -> Ask:
    def body(t, y):
        at = [t[:, i] for i in range(len(points))]
        sums = [v for a in at for v in (loss.value(a, y).sum(), loss.mistake(a, y).sum())]
        return [loss.slope(a, y) for a in at], sums

    def finish(products, sums):
        return [
            as_evaluation(np.concatenate([products[i], sums[2 * i : 2 * i + 2]]), n, w, penalty)
            for i, w in enumerate(points)
        ]

    return Ask(points, len(points), 2 * len(points), body, finish)


def ask_line(w, p, etas, n: int, loss: Loss, penalty: Penalty, slopes: bool) -> Ask:
    k = len(etas)

    def body(t, y):
        at = [t[:, 0] - e * t[:, 1] for e in etas]
        sums = [loss.value(a, y).sum() for a in at] + [loss.mistake(at[0], y).sum()]
        if slopes:
            sums += [loss.slope(a, y) @ t[:, 1] for a in at]
        return [loss.slope(at[0], y)], sums

    def finish(products, sums):
        points = [w - e * p for e in etas]
        objectives = sums[:k] / n + np.array([penalty.value(v) for v in points])
        directional = None
        if slopes:
            directional = sums[k + 1 :] / n + np.array([p @ penalty.gradient(v) for v in points])
        first = np.concatenate([products[0], [sums[0], sums[k]]])
        return objectives, directional, as_evaluation(first, n, points[0], penalty)

    return Ask([w, p], 1, k + 1 + (k if slopes else 0), body, finish)


def answer_all(ts: TrainingSet, asks: list[Ask]) -> list[object]:
    """Answer every ask in one pass over the blocks."""
    vectors = [v for a in asks for v in a.vectors]
    starts = np.cumsum([0] + [len(a.vectors) for a in asks])
    bodies = [a.body for a in asks]
    columns, sums = sum(a.columns for a in asks), sum(a.sums for a in asks)
    d = ts.d

    def term(b: Block) -> np.ndarray:
        if d > UNROLL_LIMIT:
            t = b.x @ np.array(vectors).reshape(-1, d).T
        else:
            t = np.stack([scores(b.x, v) for v in vectors], axis=1) if vectors else np.empty((len(b.y), 0))
        wanted, plain = [], []
        for body, first, last in zip(bodies, starts[:-1], starts[1:]):
            some, more = body(t[:, first:last], b.y)
            wanted += some
            plain += more
        products = np.array(wanted).reshape(columns, len(b.y)) @ b.x
        return np.concatenate([products.ravel(), plain])

    blocks, tasks = ts._held_blocks()
    with ts.block_batches():
        total = sum_over_blocks(blocks, ts.shape, columns * d + sums, tasks, term)
    products, plain = total[: columns * d].reshape(columns, d), total[columns * d :]
    out, at, spot = [], 0, 0
    for a in asks:
        out.append(a.finish(products[at : at + a.columns], plain[spot : spot + a.sums]))
        at, spot = at + a.columns, spot + a.sums
    return out


class Board:
    """Where running members leave their asks; whoever asks last runs the pass for all."""

    def __init__(self, ts: TrainingSet, members: int):
        self.ts, self.running, self.passes = ts, members, 0
        self.asks: dict[int, Ask] = {}
        self.answers: dict[int, object] = {}
        self.failed: BaseException | None = None
        self.turn = threading.Condition()

    def ask(self, member: int, ask: Ask) -> object:
        with self.turn:
            self.asks[member] = ask
            self._pass_if_complete()
            self.turn.wait_for(lambda: member in self.answers or self.failed)
            if self.failed:
                raise RuntimeError("a shared pass failed") from self.failed
            return self.answers.pop(member)

    def leave(self) -> None:
        with self.turn:
            self.running -= 1
            self._pass_if_complete()

    def _pass_if_complete(self) -> None:
        if not self.asks or len(self.asks) < self.running:
            return
        members, asks = list(self.asks), list(self.asks.values())
        self.asks.clear()
        try:
            self.answers.update(zip(members, answer_all(self.ts, asks)))
            self.passes += 1
        except BaseException as e:
            self.failed = e
        self.turn.notify_all()


class Member:
    """A training set as one member of a grid sees it: global sums only, answered with those of others."""

    def __init__(self, ts: TrainingSet, board: Board, number: int):
        self._ts, self._board, self._number = ts, board, number
        self.spark, self.d, self.n, self.profile = ts.spark, ts.d, ts.n, ts.profile
        self.check_labels = ts.check_labels

    def track(self, other: TrainingSet, loss: Loss) -> bool:
        return False

    def prepare(self, loss: Loss) -> Member:
        return self

    def _ask(self, ask: Ask):
        return self._board.ask(self._number, ask)

    def evaluate(self, w, loss: Loss, penalty: Penalty) -> Evaluation:
        return self.evaluate_all([w], loss, penalty)[0]

    def evaluate_all(self, points, loss: Loss, penalty: Penalty) -> list[Evaluation]:
        return self._ask(ask_points(list(points), self.n, loss, penalty))

    def line(self, w, p, etas, loss: Loss, penalty: Penalty, *, slopes: bool = False):
        return self._ask(ask_line(w, p, np.asarray(etas), self.n, loss, penalty, slopes))

    def gram_apply(self, p) -> np.ndarray:
        return self._ask(Ask([p], 1, 0, lambda t, y: ([t[:, 0]], []), lambda products, _: products[0]))

    def moments(self) -> np.ndarray:
        return self._ask(Ask([], 1, 0, lambda t, y: ([y], []), lambda products, _: products[0]))


def run_batched(
    ts: TrainingSet, runs: Mapping[str, Callable[..., FitResult]], **shared
) -> tuple[dict[str, FitResult], int]:
    """Run ``run_id -> fit(ts, **shared)`` together; the results and the number of passes they shared.

    For trainers made of global sums: momentum, L-BFGS, CG, FISTA, from zeros or a given start.  A
    trainer that needs shards raises an error, and so does a failed pass in every member.
    """
    ts._held_blocks()  # cached and measured before the threads start
    board = Board(ts, len(runs))
    results: dict[str, FitResult] = {}
    errors: list[BaseException] = []

    def member(number: int, run_id: str, fit) -> None:
        try:
            results[run_id] = fit(Member(ts, board, number), **shared)
        except BaseException as e:
            errors.append(e)
        finally:
            board.leave()

    threads = [
        threading.Thread(target=member, args=(i, run_id, fit), daemon=True)
        for i, (run_id, fit) in enumerate(runs.items())
    ]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return {run_id: results[run_id] for run_id in runs}, board.passes
