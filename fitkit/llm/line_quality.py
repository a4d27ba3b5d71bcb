"""Document quality from a linear-chain conditional random field over lines.

Every line of a document is good or bad.  A line's own measures and those of its two neighbours speak
for its label, and two weights speak for neighbours of equal labels.  Training knows labels of
documents only: a good one has good lines throughout, a bad one has at least one bad line.  The model
maximises the probability of exactly that, ``P(all lines good)`` of good documents and ``1 - P(all lines
good)`` of bad ones, both of which the forward recursion gives.

Forward and backward recursions yield the probability of every line to be good.  Their mean, weighted
by the length of the lines, is the share of the text that is good; a logistic curve, fitted to documents
that the weights were not learned from, turns it into the score of the document.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import map_rows, texts

#: Labelled documents to learn from at most, taken by a hash of the id, and lines that they may have
#: together; a document that would go beyond the lines is left out of the learning.
LABELLED_ROWS = 6_000
LABELLED_LINES = 200_000
#: The share of them that fits the curve and not the weights.
CALIBRATE = 4
RIDGE = 1.0
STEPS = 150
THRESHOLD = 0.5
FLOOR = 1e-3
#: Bytes of lines that are measured at once; longer lines are cut into words one at a time.
CHUNK = 4 << 20

#: Kinds of bytes that are counted: symbols of markup and tables, marks of emphasis, digits, capitals,
#: small letters, punctuation of prose, bars, bytes of characters beyond ASCII.
KINDS = [b"#*$%&<>=+@^~_{}[]\\/", b"!?", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:'\"()-", b"|", bytes(range(128, 256))]
_KIND = np.zeros(256, np.uint8)
for _k, _members in enumerate(KINDS):
    _KIND[list(_members)] = _k + 1
OWN = len(KINDS) + 7
WIDTH = 3 * OWN + 2


def _repeats(line: bytes) -> tuple[int, int, int, int]:
    """Words, distinct words, three-word windows and distinct ones."""
    if len(line) < CHUNK:
        words = line.split()
        return len(words), len(set(words)), max(0, len(words) - 2), len(set(zip(words, words[1:], words[2:])))
    codes = array("q", (hash(m[0]) for m in re.finditer(rb"\S+", line)))
    w = np.frombuffer(codes, np.int64).view(np.uint64)
    windows = w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]
    return len(w), len(np.unique(w)), len(windows), len(np.unique(windows))


def _shares(lines: list[bytes]) -> np.ndarray:
    """The share of each kind of byte in each line, chunk by chunk."""
    out = np.zeros((len(lines), len(KINDS)))
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) < CHUNK):
            size += len(lines[end])
            end += 1
        lengths = np.array([len(x) for x in lines[at:end]])
        kind = _KIND[np.frombuffer(b"".join(lines[at:end]), np.uint8)]
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        for k in range(len(KINDS)):
            out[at:end, k] = np.add.reduceat(kind == k + 1, starts, dtype=np.int64) / lengths
        at = end
    return out


def measure(docs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines, their lengths, and how many lines each text has.

    Lines end at line feeds; those without a word are no lines.
    """
    lines, counts, more = [], [], []
    for text in docs:
        own = [x for x in (text or b"").split(b"\n") if x.strip()]
        copies = Counter(own)
        for x in own:
            words, distinct, windows, apart = _repeats(x)
            more.append(
                (
                    np.log1p(words) / 5,
                    words < 5,
                    min(2.0, len(x) / words / 10),
                    np.log(words / distinct),
                    np.log((windows + 1) / (apart + 1)),
                    1 - apart / windows if windows else 0.0,
                    copies[x] > 1,
                )
            )
        lines += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0), counts
    own = np.concatenate([_shares(lines), np.array(more, np.float64)], axis=1)
    first = np.zeros(len(lines), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], 0.0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0.0, np.roll(own, -1, axis=0))
    x = np.concatenate([own, before, after, first[:, None], last[:, None]], axis=1)
    return x, np.array([len(v) for v in lines], np.float64), counts


class Chains:
    """Sequences side by side: step ``t`` works on the ``t``-th lines of all that have one."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.start = np.cumsum(counts) - counts
        self.order = np.argsort(-counts, kind="stable")
        lengths = counts[self.order]
        self.steps = []
        n = int((lengths > 0).sum())
        for t in range(int(lengths.max(initial=0))):
            while n and lengths[n - 1] <= t:
                n -= 1
            self.steps.append(self.start[self.order[:n]] + t)

    def forward(self, u: np.ndarray, bad: float, good: float) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the forward messages by line, and the log of the norm by sequence.

        ``u`` is what speaks for good by line; ``bad`` and ``good`` for equal neighbours.
        """
        ahead, base = np.empty_like(u), np.zeros(len(self.counts))
        odds = np.empty(0)
        for t, at in enumerate(self.steps):
            if t == 0:
                odds = u[at]
            else:
                odds = odds[: len(at)]
                stay = np.logaddexp(odds, bad)
                base[self.order[: len(at)]] += stay
                odds = u[at] + np.logaddexp(odds + good, 0.0) - stay
            ahead[at] = odds
        held = self.counts > 0
        ends = (self.start + self.counts - 1)[held]
        base[held] += np.logaddexp(0.0, ahead[ends])
        return ahead, base

    def backward(self, u: np.ndarray, bad: float, good: float) -> np.ndarray:
        """Log odds of the backward messages by line."""
        behind = np.zeros_like(u)
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            odds = u[at] + behind[at]
            behind[at - 1] = np.logaddexp(odds + good, 0.0) - np.logaddexp(odds, bad)
        return behind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def marginals(chains: Chains, u: np.ndarray, bad: float, good: float) -> np.ndarray:
    """The probability of each line to be good."""
    return _sigmoid(chains.forward(u, bad, good)[0] + chains.backward(u, bad, good))


def _objective(theta: np.ndarray, x: np.ndarray, chains: Chains, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of the document labels with a ridge, and its gradient."""
    w, bad, good = theta[:-2], theta[-2], theta[-1]
    u = x @ w
    ahead, norm = chains.forward(u, bad, good)
    behind = chains.backward(u, bad, good)
    n = chains.counts
    doc = np.repeat(np.arange(len(n)), n)
    all_good = np.bincount(doc, u, len(n)) + np.maximum(n - 1, 0) * good - norm
    all_good = np.minimum(all_good, -1e-12)
    p = np.exp(all_good)
    value = -np.where(labels == 1, all_good, np.log1p(-p)).sum()
    pull = np.where(labels == 1, 1.0, -p / np.maximum(1 - p, 1e-12))
    slope = np.zeros_like(theta)
    slope[:-2] = -((pull[doc] * (1 - _sigmoid(ahead + behind))) @ x)
    inner = np.ones(len(doc), bool)
    inner[chains.start[n > 0]] = False
    at = np.flatnonzero(inner)
    here = u[at] + behind[at]
    parts = np.stack([np.full(len(at), bad), here, ahead[at - 1], ahead[at - 1] + good + here])
    parts = np.exp(parts - parts.max(axis=0))
    parts /= parts.sum(axis=0)
    slope[-2] = pull[doc[at]] @ parts[0]
    slope[-1] = -(pull[doc[at]] @ (1 - parts[3]))
    return value + 0.5 * RIDGE * float(theta @ theta), slope + RIDGE * theta


def minimise(body, theta: np.ndarray, steps: int, memory: int = 12) -> np.ndarray:
    """Limited-memory BFGS with halved steps until the value falls enough."""
    value, slope = body(theta)
    pairs: deque = deque(maxlen=memory)
    for _ in range(steps):
        way, left = -slope, []
        for s, y, r in reversed(pairs):
            a = r * (s @ way)
            left.append(a)
            way = way - a * y
        if pairs:
            s, y, _ = pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(left)):
            way = way + (a - r * (y @ way)) * s
        size, falls = (1.0 if pairs else min(1.0, 1.0 / np.abs(slope).max(initial=1e-12))), float(way @ slope)
        while size > 1e-10:
            found, new = body(theta + size * way)
            if found <= value + 1e-4 * size * falls:
                break
            size /= 2
        else:
            break
        s, y = size * way, new - slope
        done = value - found <= 1e-7 * max(1.0, abs(value))
        theta, value, slope = theta + s, found, new
        if s @ y > 1e-12:
            pairs.append((s, y, 1.0 / (s @ y)))
        if done:
            break
    return theta


@dataclass
class LineModel:
    """Centre and scale of the measures, weights of the lines and of equal neighbours, the curve."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    bad: float
    good: float
    slope: float
    offset: float

    def lines(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        u = ((x - self.centre) / self.scale) @ self.weights + self.bias
        return marginals(Chains(counts), u, self.bad, self.good)

    def evidence(self, good: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log odds of the share of good text; none without lines."""
        doc = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(doc, lengths, len(counts))
        held = np.bincount(doc, lengths * good, len(counts))
        share = np.where(total > 0, held / np.maximum(total, 1), 1.0)
        return np.log((share + FLOOR) / (1 - share + FLOOR))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * evidence + self.offset)


def learning_part(doc_id="doc_id"):
    """True where crc32 of the id as text leaves 0 or 2 on division by 3 (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``spot, label, text`` of at most ``rows`` labelled documents of the learning part.

    Ids with contradicting labels, null ids and null labels are left aside; of rows that share an id
    one text is taken.
    """
    usable = (
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .filter(learning_part())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
    )
    sample = (
        usable.select(F.xxhash64("doc_id").alias("spot"), F.col("doc_id").alias("__id"), F.col("low").cast("int").alias("label"))
        .orderBy("spot", "__id")
        .limit(rows)
    )
    held = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    return held.groupBy("spot", "__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, lines: int = LABELLED_LINES) -> LineModel:
    """Learn from ``doc_id, text`` and ``doc_id, quality``.

    Measures are taken where the documents lie; those of the bounded sample come to the driver.
    Without labels of both kinds every score is the share of good labels (0.5 without labels).
    """

    def body():
        def kernel(batch):
            found = [measure([t]) for t in texts(batch, 3)]
            return {
                "spot": batch.column(0),
                "label": batch.column(2),
                "x": [x.astype("<f4").tobytes() for x, _, _ in found],
                "lengths": [n.astype("<f8").tobytes() for _, n, _ in found],
            }

        return kernel

    schema = T.StructType(
        [
            T.StructField("spot", T.LongType()),
            T.StructField("label", T.IntegerType()),
            T.StructField("x", T.BinaryType()),
            T.StructField("lengths", T.BinaryType()),
        ]
    )
    measured = map_rows(_labelled(docs, labels, rows), body, schema)
    xs, sizes, counts, kinds, spots = [], [], [], [], []
    for r in measured.orderBy("spot").toLocalIterator():
        n = len(r["lengths"]) // 8
        if n and sum(counts) + n <= lines:
            xs.append(np.frombuffer(r["x"], "<f4").reshape(n, WIDTH))
            sizes.append(np.frombuffer(r["lengths"], "<f8"))
            counts.append(n)
            kinds.append(r["label"])
            spots.append(r["spot"])
    label = np.array(kinds, np.int64)
    base = float(label.mean()) if len(label) else 0.5
    plain = LineModel(
        np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.0, 0.0, 0.0, float(np.log((base + 1e-9) / (1 - base + 1e-9)))
    )
    if not len(label) or not 0 < base < 1:
        return plain
    counts = np.array(counts, np.int64)
    x, lengths = np.concatenate(xs).astype(np.float64), np.concatenate(sizes)
    apart = np.array(spots, np.int64) // 7 % CALIBRATE == 0
    if len(set(label[~apart])) < 2 or len(set(label[apart])) < 2:
        apart[:] = False
    held = np.repeat(~apart, counts)
    centre = x[held].mean(axis=0)
    scale = x[held].std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    theta = np.zeros(WIDTH + 3)
    theta[WIDTH] = 2.0
    chains = Chains(counts[~apart])
    theta = minimise(lambda v: _objective(v, z[held], chains, label[~apart]), theta, STEPS)
    model = LineModel(centre, scale, theta[:WIDTH], float(theta[WIDTH]), float(theta[-2]), float(theta[-1]), 1.0, 0.0)
    check = apart if apart.any() else ~apart
    at = np.repeat(check, counts)
    good = model.lines(x[at], counts[check])
    model.slope, model.offset = _curve(model.evidence(good, lengths[at], counts[check]), label[check])
    return model


def _curve(e: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a weak ridge."""
    z = np.stack([e, np.ones_like(e)], axis=1)

    def body(beta):
        t = z @ beta
        slope = z.T @ (_sigmoid(t) - y) + 0.1 * beta
        return float(np.logaddexp(0, t).sum() - y @ t + 0.05 * beta @ beta), slope

    return tuple(map(float, minimise(body, np.zeros(2), 100)))


def score_quality(docs: DataFrame, model: LineModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, good_share, lines`` for every row of ``docs``.

    ``lines`` has the length in bytes and the probability to be good of each line with a word, in order.
    A null or empty text, or one of blank lines, has no line: its share of good text is 1.  Repeated rows
    keep their rows, a null id stays null; an empty table gives an empty result; other columns are not
    read.  A text of any length is one chain; the work grows with its length.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(T.StructType([T.StructField("size", T.LongType()), T.StructField("good", T.DoubleType())]))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("good_share", T.DoubleType()),
            T.StructField("lines", spans),
        ]
    )

    def body():
        model = held.value

        def kernel(batch):
            x, lengths, counts = measure(texts(batch, 1))
            good = model.lines(x, counts)
            evidence = model.evidence(good, lengths, counts)
            score = model.score(evidence)
            odds = np.exp(evidence)
            share = np.clip((odds * (1 + FLOOR) - FLOOR) / (1 + odds), 0, 1)
            size, p, at = lengths.astype(np.int64).tolist(), good.tolist(), 0
            lines = []
            for n in counts.tolist():
                lines.append([{"size": a, "good": b} for a, b in zip(size[at : at + n], p[at : at + n])])
                at += n
            return {
                "doc_id": batch.column(0),
                "score": score,
                "predicted": (score >= THRESHOLD).astype(np.int32),
                "good_share": share,
                "lines": lines,
            }

        return kernel

    return map_rows(docs.select(F.col(id_col), F.col(text_col).cast("string")), body, schema)
