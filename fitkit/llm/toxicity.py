"""Toxic passages as maximum-scoring segments of token log-odds.

Token weights are log-odds between toxic and other labelled documents under a Dirichlet
prior, shrunk towards zero by their standard error.
A linear scan (Ruzzo and Tompa) finds all maximal segments of a document.  Segment scores
are calibrated as extreme values (Karlin and Altschul): with the rate ``lam`` that solves
``E[exp(lam * weight)] = 1`` over clean text and a constant ``k`` fitted to clean documents, a
segment of score s in n tokens has the normalised score ``lam * s - log(k * n)``.  A document
adds up the significant ones, and a logistic curve turns that evidence into a probability.

The model holds only the words whose log-odds stand out, and stems: beginnings that many
different words share, for languages that inflect or compound.  A word that does not stand out
itself weighs as its best stem; all others weigh a small constant below zero.  Frequencies cover all documents; labels come from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import Scratch, held_out, map_rows, set_aside

#: Labelled rows that are used at most; they are taken by a hash of the id.
LABELLED_ROWS = 20_000
#: Documents that the Dirichlet prior of a token is worth, split by the share of toxic ones.
PRIOR = 4.0
SHRINK = 3.0
#: Clean documents that the prior of the extreme-value constant, zero on the log scale, is worth.
CHANCE_PRIOR = 25
DRIFT = 0.15
#: Bytes of a stem, and the different words that it must begin: one word's beginning is no stem.
STEM_BYTES = (4, 8)
STEM_WORDS = 8
#: Words whose weights a task remembers.
REMEMBERED = 200_000
THRESHOLD = 0.3

_SEPARATORS = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII signs separate them."""
    return text.lower().encode("utf-8", "replace").translate(_SEPARATORS).split() if text else []


def maximal_segments(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal scoring segments: starts, ends (exclusive) and sums, in order.

    Linear in the number of runs: neighbouring scores of one sign are one run first.
    """
    if not len(scores) or not (scores > 0).any():
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    cut = np.flatnonzero(np.diff((scores > 0).astype(np.int8))) + 1
    begin = np.r_[0, cut]
    end = np.r_[cut, len(scores)]
    total = np.add.reduceat(scores, begin)
    stack: list[tuple[int, int, float, float]] = []  # first run, last run, left and right sum
    run = 0.0
    for i, x in enumerate(total.tolist()):
        left, run = run, run + x
        if x <= 0:
            continue
        first, low, high = i, left, run
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, i, low, high))
    return (
        np.array([begin[s[0]] for s in stack]),
        np.array([end[s[1]] for s in stack]),
        np.array([s[3] - s[2] for s in stack]),
    )


class Lexicon(dict):
    """What each word weighs by: itself, its best stem, or nothing (None).  Remembers words met."""

    def __init__(self, weights: dict[bytes, float], stems: dict[bytes, float]):
        super().__init__()
        self.weights, self.stems = weights, stems

    def __missing__(self, word: bytes) -> tuple[bool, bytes] | None:
        if len(self) > REMEMBERED:
            self.clear()
        if word in self.weights:
            found = False, word
        else:
            heads = (word[:k] for k in range(STEM_BYTES[0], min(len(word), STEM_BYTES[1]) + 1))
            best = max((h for h in heads if h in self.stems), key=self.stems.__getitem__, default=None)
            found = None if best is None else (True, best)
        self[word] = found
        return found


class Scores(Lexicon):
    """The weight of each word."""

    def __missing__(self, word: bytes) -> float:
        found = super().__missing__(word)
        if found is None:
            weight = -DRIFT
        else:
            weight = (self.stems if found[0] else self.weights)[found[1]]
        self[word] = weight
        return weight


@dataclass
class ToxicityModel:
    """Weights of telling words and stems, the extreme-value constants and the logistic curve."""

    weights: dict[bytes, float]
    stems: dict[bytes, float]
    lam: float
    log_k: float
    slope: float
    offset: float

    def __post_init__(self):
        self._scores = Scores(self.weights, self.stems)

    def __reduce__(self):  # what a task remembers stays there
        return ToxicityModel, (self.weights, self.stems, self.lam, self.log_k, self.slope, self.offset)

    def token_scores(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self._scores.__getitem__, words_of(text))), np.float64)

    def significant(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Significant segments and their normalised scores."""
        start, end, raw = maximal_segments(scores)
        value = self.lam * raw - self.log_k - np.log(max(1, len(scores)))
        ok = value > 0
        return start[ok], end[ok], value[ok]

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * evidence + self.offset))))


def evidence_of(values: np.ndarray) -> float:
    return float(np.log1p(values.sum()))


def _telling_words(
    docs: DataFrame, learn: DataFrame, base: float, scratch: Scratch
) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words and stems whose log-odds stand out of their standard error, with the shrunk log-odds.

    Counts are documents by label that use a word.  A sentence speaks for one document of its
    label only, however many copies hold it: otherwise one mislabelled document with many copies
    would teach its own words.  Stems speak for toxic text only.  Only the words that stand out come to the driver; each needs
    several labelled documents, so the sample bounds their number.
    """
    sentences = (
        docs.join(F.broadcast(learn), docs.doc_id == learn.__id)
        .select(
            F.explode(F.split("text", "[.!?\\n]+")).alias("text"),
            F.col("__toxic").alias("kind"),
            F.col("__id").alias("doc"),
        )
        .groupBy("text", "kind")
        .agg(F.min("doc").alias("doc"))
    )

    def run(batches):
        for batch in batches:
            rows = [words_of(t.as_py()) for t in batch.column(0)]
            sizes = [len(r) for r in rows]
            kinds = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes)
            docs = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), sizes)
            words = pa.array([w for r in rows for w in r], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs.astype(np.int64)), pa.array(kinds.astype(np.int32)), words],
                ["doc", "kind", "word"],
            )

    used = scratch.keep(sentences.mapInArrow(run, "doc long, kind int, word binary").distinct())
    toxic, clean = F.col("t") + PRIOR * base, F.col("c") + PRIOR * (1 - base)
    odds = F.log(toxic / clean) - float(np.log(base / (1 - base)))
    error = F.sqrt(1 / toxic + 1 / clean)
    by_kind = [F.sum("kind").alias("t"), F.sum(1 - F.col("kind")).alias("c")]

    def telling(counts: DataFrame) -> dict[bytes, float]:
        found = counts.select("word", odds.alias("odds"), error.alias("error"))
        return {
            bytes(r["word"]): float(np.sign(r["odds"]) * (abs(r["odds"]) - SHRINK * r["error"]) - DRIFT)
            for r in found.filter(F.abs("odds") > SHRINK * F.col("error")).collect()
        }

    words = telling(used.groupBy("word").agg(*by_kind))
    # Words that stand out weigh by themselves and don't speak for their stems.
    own = docs.sparkSession.createDataFrame([(w,) for w, x in words.items() if x > 0], "word binary")
    # Different words of a stem, counted from below: each sets one of 64 bits.
    one, place = F.lit(1).cast("long"), F.pmod(F.xxhash64("word"), F.lit(64)).cast("int")
    bit = F.call_function("shiftleft", one, place)
    size = F.octet_length("word")
    heads = F.transform(
        F.sequence(F.lit(STEM_BYTES[0]), F.least(F.lit(STEM_BYTES[1]), size)),
        lambda k: F.substring(F.col("word"), F.lit(1), k),
    )
    stems = (
        used.filter(size >= STEM_BYTES[0])
        .join(F.broadcast(own), "word", "left_anti")
        .select("doc", "kind", F.explode(heads).alias("stem"), bit.alias("bit"))
        .groupBy("stem", "kind", "doc")
        .agg(F.bit_or("bit").alias("bits"))
        .groupBy(F.col("stem").alias("word"))
        .agg(*by_kind, F.bit_or("bits").alias("bits"))
        .filter(F.bit_count("bits") >= STEM_WORDS)
    )
    return words, {w: x for w, x in telling(stems).items() if x > 0}


def _frequencies(
    docs: DataFrame, weights: dict[bytes, float], stems: dict[bytes, float]
) -> tuple[dict[tuple[bool, bytes], int], int]:
    """How often each word and each stem is what a token of any document weighs by, and all tokens."""
    held = docs.sparkSession.sparkContext.broadcast((weights, stems))

    def run(batches):
        total, counts = 0, Counter()
        lexicon = Lexicon(*held.value)
        for batch in batches:
            for t in batch.column(0):
                tokens = words_of(t.as_py())
                total += len(tokens)
                counts.update(filter(None, map(lexicon.__getitem__, tokens)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None, *(k[0] for k in counts)], pa.bool_()),
                pa.array([None, *(k[1] for k in counts)], pa.binary()),
                pa.array([total, *counts.values()], pa.int64()),
            ],
            ["stem", "word", "n"],
        )

    rows = docs.select("text").mapInArrow(run, "stem boolean, word binary, n long")
    got = {
        None if r["word"] is None else (r["stem"], bytes(r["word"])): r["n"]
        for r in rows.groupBy("stem", "word").agg(F.sum("n").alias("n")).collect()
    }
    total = got.pop(None, 0)
    return got, total


def sample_labels(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """``__id, __toxic``: labelled rows to learn from, at most ``rows`` of them by hash of the id.

    Rows with crc32(id) mod 4 = 2 are held out.  Ids with contradicting labels, null ids and
    null labels are left aside.
    """
    usable = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
        .filter("low = high")
    )
    return (
        usable.orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("__id"), F.col("low").cast("int").alias("__toxic"))
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Learn token weights and calibration; needs ``doc_id, text`` and ``doc_id, toxic``.

    Without any toxic or any clean labelled document nothing can be learned: no word tells
    anything and every score is the share of toxic labels (0 without labels).
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.select("doc_id", "text")
    sample = scratch.keep(sample_labels(labels, rows))
    # A third of the sample calibrates; its words are not learned from.
    third = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)) == 0
    learn, check = sample.filter(~third), sample.filter(third)
    share = {r["__toxic"]: r["count"] for r in sample.groupBy("__toxic").count().collect()}
    n_toxic, n_clean = share.get(1, 0), share.get(0, 0)
    base = n_toxic / max(1, n_toxic + n_clean)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, {}, 1.0, 0.0, 0.0, float(np.log((base + 1e-9) / (1 - base + 1e-9))))
    weights, stems = _telling_words(docs, learn, base, scratch)
    counts, total = _frequencies(docs, weights, stems)
    # The rate at which clean text makes high scores: a telling word is met in clean text as often
    # as it would be if labels were drawn at random, discounted by its own odds.
    names = [*((False, n) for n in weights), *((True, n) for n in stems)]
    w = np.array([*weights.values(), *stems.values()])
    chance = np.array([counts.get(n, 0) for n in names]) * np.exp(-np.maximum(w, 0)) / max(1, total)
    low, high = 1e-3, 50.0
    if (w > 0).any():
        for _ in range(80):
            lam = (low + high) / 2
            rest = (1 - min(1.0, chance.sum())) * np.exp(-lam * DRIFT)
            value = np.sum(chance * np.exp(np.minimum(lam * w, 600))) + rest
            low, high = (lam, high) if value < 1 else (low, lam)
    model = ToxicityModel(weights, stems, float(low), 0.0, 1.0, 0.0)
    measured = _measure(docs, check, model).toPandas()
    if measured.empty:
        return model
    best, n, y = (measured[c].to_numpy(np.float64) for c in ("best", "n", "toxic"))
    # Gumbel: the mean of lam * best - log n over clean documents is log k + 0.5772.
    plain = (low * best - np.log(np.maximum(1, n)))[(y == 0) & (best > 0)]
    # Few documents leave it near zero, a segment as good as by chance for every token.
    model.log_k = float((plain - 0.5772).sum() / (len(plain) + CHANCE_PRIOR))
    evidence = _measure(docs, check, model).toPandas()
    model.slope, model.offset = _logistic(
        evidence["evidence"].to_numpy(np.float64), evidence["toxic"].to_numpy(np.float64)
    )
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps with a weak prior on the slope."""
    beta = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * beta)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def _measure(docs: DataFrame, sample: DataFrame, model: ToxicityModel) -> DataFrame:
    """``toxic, n, best, evidence`` of the labelled sample (bounded)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.join(F.broadcast(sample), docs.doc_id == sample.__id).select("text", "__toxic")

    def body():
        def kernel(batch):
            n, best, evidence = [], [], []
            for t in batch.column(0):
                scores = held.value.token_scores(t.as_py())
                sums = maximal_segments(scores)[2]
                n.append(len(scores))
                best.append(float(sums.max()) if len(sums) else 0.0)
                evidence.append(evidence_of(held.value.significant(scores)[2]))
            return {"toxic": batch.column(1).to_pylist(), "n": n, "best": best, "evidence": evidence}

        return kernel

    return map_rows(
        rows,
        body,
        T.StructType(
            [
                T.StructField("toxic", T.IntegerType()),
                T.StructField("n", T.LongType()),
                T.StructField("best", T.DoubleType()),
                T.StructField("evidence", T.DoubleType()),
            ]
        ),
    )


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``segments`` (token start, end, value).

    A null or empty text has no segment and gets the score of no evidence.  Every row gives a
    row, repeated ones too; input columns named like the new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    spans = T.ArrayType(
        T.StructType(
            [
                T.StructField("start", T.LongType()),
                T.StructField("end", T.LongType()),
                T.StructField("value", T.DoubleType()),
            ]
        )
    )
    kept = [f for f in docs.schema if f.name not in ("score", "predicted", "segments")]
    schema = T.StructType(
        [
            *kept,
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("segments", spans),
        ]
    )
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept])

    def body():
        model = held.value

        def kernel(batch):
            score, segments = [], []
            for t in batch.column("text"):
                start, end, value = model.significant(model.token_scores(t.as_py()))
                score.append(model.probability(evidence_of(value)))
                segments.append(
                    [{"start": int(a), "end": int(b), "value": float(v)} for a, b, v in zip(start, end, value)]
                )
            out = {f.name: batch.column(f.name) for f in kept}
            return out | {
                "score": score,
                "predicted": [int(s >= threshold) for s in score],
                "segments": segments,
            }

        return kernel

    return map_rows(rows, body, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    model = fit_toxicity(docs, labels)
    renamed, back = set_aside(docs, ("score", "predicted", "segments"))
    return back(score_toxicity(renamed, model).filter("predicted = 0"))
