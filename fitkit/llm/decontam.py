"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are cut into passages, weighted by TF-IDF over the words of the
benchmark (other words add nothing to a cosine with an item) and projected on the leading right
singular vectors of the passage matrix, found by a distributed randomised SVD.  The passages of
the items weigh so much in that matrix that the space holds them whole.  Every region of every
document is compared with every item passage in that space; candidates are then checked by the
longest common subsequence of their words and by the words of the answer.

A region is a candidate when its part along the passage is as long as the check asks for.  What
the check can accept misses at most some of the passage's words; without the heaviest ones of
these the rest of the passage has a length that follows from its weights, and no region below
that length is looked at.  So the search loses nothing that the check would keep.  A region that
holds nearly the whole weight of a passage counts as a paraphrase already when half of its words
stand in order.

Document frequencies cover all documents, the basis is fitted on all their windows and all item
passages, and the search covers all regions.  One pass over the texts adds up the products of all
pairs of words that share a window; the rounds of the decomposition read these sums alone.  Passages
are handled in blocks of ``BLOCK_PASSAGES``, so that what is broadcast is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import map_rows, set_aside
from fitkit.llm.quality import let

#: Words in half a window; a passage has at most two halves.  Regions of three halves begin half a
#: half before each half but the last, so they overlap by two halves.
HALF = 32
QUARTER = HALF // 2
BLOCK_PASSAGES = 512
#: A passage weighs in the fit as much as this many windows, or as ten times all windows if that is more.
HEAVY = 500_000
#: Directions of the space beside those of the passages.
RANK = 64
OVERSAMPLE = 16
#: Words in more than this share of the documents weigh nothing, unless an item has no others.
COMMON = 0.1
LCS = 0.7
#: A paraphrase holds this share of the passage's length and this share of its words in order.
HELD = 0.8
LOOSE = 0.5
#: Quarters summed at once.
GATHERED = 256
#: Windows of a text and words of several whose pairs are formed at once.
SLICE = 1024
FIT_WORDS = 1 << 16
#: Pairs of the first so many words of a vocabulary are summed in a table, others gathered, so many at once.
HEAD = 4096
PAIRS = 1 << 20
#: Words in a strip of the sums, and sums in one of its rows.
STRIP = 64
CELLS = 1 << 17
#: Tasks that sum, where the documents lie in more: each sends every pair it met, however much it read.
FIT_TASKS = 64
#: Share of a bar that the sums over words may be off; what comes that near is measured in the space.
FAINT = 1e-3
#: What the part along a passage may lose by rounding and by the projection.
SLACK = 0.97
#: An item with fewer words counts only where it stands word for word.
SHORT = 8

_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SEPARATORS).split() if text else []


def answer_of(text: str) -> str:
    """What stands behind an answer mark, else the last sentence."""
    marked = re.split(r"(?i)\b(?:answer|a)\s*:", text)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    sentences = [s for s in re.split(r"[.!?]\s+|\n", text.strip()) if s.strip()]
    return sentences[-1] if sentences else text


def lcs_length(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Longest common subsequence with a text of n words, given the bit masks of its words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Passage:
    item: object
    words: list[bytes]
    answer: list[bytes]
    masks: dict[bytes, int] = field(default_factory=dict)
    answer_masks: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self):
        self.masks, self.answer_masks = masks_of(self.words), masks_of(self.answer)

    @property
    def need(self) -> int:
        """The fewest words in order that the check accepts without the length along the passage."""
        n = len(self.words)
        return n if n < SHORT else next(x for x in range(n + 1) if x / n >= LCS)

    def accepts(self, share: float, answer: float, held: float) -> bool:
        if share >= LCS and answer >= LCS:
            return True
        return len(self.words) >= SHORT and held >= HELD and share >= LOOSE and answer >= LOOSE

    def verify(self, region: list[bytes]) -> tuple[float, float]:
        """Shares of the passage and of its answer that the region holds in order."""
        n = len(self.words)
        share = lcs_length(self.masks, n, region) / n
        if n < SHORT:
            whole = any(region[i : i + n] == self.words for i in range(len(region) - n + 1))
            return (1.0, 1.0) if whole else (0.0, 0.0)
        if share < LOOSE or not self.answer:
            return share, share
        return share, lcs_length(self.answer_masks, len(self.answer), region) / len(self.answer)


def passages_of(item: object, text: str | None) -> list[Passage]:
    """An item in parts of at most a window; the answer belongs to the part that holds it."""
    words = words_of(text)
    if not words:
        return []
    count = -(-len(words) // (2 * HALF))
    cuts = [len(words) * k // count for k in range(count + 1)]
    answer = words_of(answer_of(text))
    parts = []
    for k in range(count):
        part = words[cuts[k] : cuts[k + 1]]
        held = lcs_length(masks_of(answer), len(answer), part) == len(answer) if answer else False
        parts.append(Passage(item, part, answer if held else []))
    return parts


@dataclass
class LatentIndex:
    """A block of passages: vocabulary, weights, basis and the passages in the latent space."""

    vocabulary: dict[bytes, int]  # words that weigh something
    basis: np.ndarray  # words x rank, rows scaled by the weight
    passages: list[Passage]
    vectors: np.ndarray  # passages x rank, length 1
    lengths: np.ndarray  # of the passages before that
    bars: np.ndarray  # the part along the passage that a candidate has at least

    def __post_init__(self):
        """The parts of each word along the passages, word after word; nearly all are zero and left out.

        What the words of a region lose by that is less than ``FAINT`` of a bar together.
        """
        along = self.basis @ self.vectors.T
        word, self.passage = np.nonzero(np.abs(along) > FAINT / (6 * QUARTER) * self.bars)
        self.part = along[word, self.passage].astype(np.float64)
        self.first = np.searchsorted(word, np.arange(len(along) + 1))

    def region(self, ids: np.ndarray) -> np.ndarray:
        """A region with these words (-1 for those that weigh nothing) in the space, quarter by quarter."""
        out = np.zeros(self.basis.shape[1], np.float32)
        for k in range(0, len(ids), QUARTER):
            quarter = ids[k : k + QUARTER]
            out += self.basis[quarter[quarter >= 0]].sum(axis=0)
        return out


def least_parts(passages: list[Passage], weight_of: dict[bytes, float]) -> np.ndarray:
    """The shortest part along each passage that the check can accept, as :func:`search_texts` measures it.

    A region that misses places of a passage loses, of the squared length, the weight of each missing
    place times that word's weight in the passage: the heaviest ones are taken for missing.
    """
    out = np.zeros(len(passages))
    for i, p in enumerate(passages):
        times = {w: m.bit_count() for w, m in p.masks.items()}
        parts = sorted(times[w] * weight_of[w] ** 2 for w in p.words)
        length = np.sqrt(sum((n * weight_of[w]) ** 2 for w, n in times.items()))
        if length > 0:
            out[i] = min(sum(parts[: p.need]) / length, HELD * length)
    return out


def _quarter_parts(ids: np.ndarray, index: LatentIndex) -> np.ndarray:
    """Parts along the passages of each quarter of a window; ids are -1 for words that weigh nothing."""
    count = len(index.passages)
    out = np.zeros((max(1, -(-len(ids) // QUARTER)), count), np.float32)
    at = np.flatnonzero(ids >= 0)
    for k in range(0, len(out), GATHERED):  # so many quarters at once, as a word may lie along many passages
        some = out[k : k + GATHERED]
        mine = at[slice(*np.searchsorted(at, [k * QUARTER, (k + GATHERED) * QUARTER]))]
        first = index.first[ids[mine]]
        sizes = index.first[ids[mine] + 1] - first
        ends = np.cumsum(sizes)
        if len(mine) and ends[-1]:
            entry = np.arange(ends[-1]) + np.repeat(first - ends + sizes, sizes)
            cell = np.repeat(mine // QUARTER - k, sizes) * count + index.passage[entry]
            some += np.bincount(cell, index.part[entry], some.size).reshape(some.shape)
    return out


def _regions(quarters: np.ndarray, n_words: int) -> np.ndarray:
    """Sums over the regions: six quarters each, the k-th from the quarter before word ``k * HALF`` on."""
    count = max(1, -(-n_words // HALF) - 1)
    padded = np.zeros((2 * count + 5, quarters.shape[1]), np.float32)
    some = min(len(quarters), len(padded) - 1)
    padded[1 : 1 + some] = quarters[:some]
    out = padded[0 : 2 * count : 2].copy()
    for k in range(1, 6):
        out += padded[k : k + 2 * count : 2]
    return out


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str):
    """Documents that use each word of the vocabulary, all documents, and all windows."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = held.value.get
        counts = np.zeros(len(held.value) + 2, np.int64)
        for batch in batches:
            for t in batch.column(0):
                words = words_of(t.as_py())
                used = {i for w in words if (i := get(w)) is not None}
                counts[list(used)] += 1
                counts[-2] += 1
                counts[-1] += max(1, -(-len(words) // HALF) - 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["i", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "i long, n long")
    counts = np.zeros(len(vocabulary) + 2, np.int64)
    for r in rows.groupBy("i").agg(F.sum("n").alias("n")).collect():  # one row a benchmark word
        counts[r["i"]] = r["n"]
    return counts[:-2], int(counts[-2]), int(counts[-1])


def word_weights(df: np.ndarray, n_docs: int, passages: list[Passage], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Inverse document frequencies; frequent words weigh nothing where an item has three others."""
    idf = np.log((1 + n_docs) / (1 + df)) + 0.05
    common = df > COMMON * max(n_docs, 1)
    for p in passages:
        ids = [vocabulary[w] for w in set(p.words)]
        if sum(not common[i] for i in ids) < 3:
            common[ids] = False
    idf[common] = 0
    return idf.astype(np.float32)


STRIPS = pa.schema([("strip", pa.int32()), ("cells", pa.binary()), ("sums", pa.binary())])


def _strips(code: np.ndarray, sums: np.ndarray, width: int) -> pa.RecordBatch:
    """Sums by strips of rows, at most ``CELLS`` in one; a code is row times width plus column, codes rise."""
    strip = code // (STRIP * width)
    cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(strip)) + 1, np.arange(0, len(code), CELLS), [len(code)]]))
    cells, sums = (code - strip * STRIP * width).astype(np.uint32), sums.astype(np.float32)
    parts = [slice(x, y) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    columns = [strip[cuts[:-1]], [cells[p].tobytes() for p in parts], [sums[p].tobytes() for p in parts]]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, STRIPS)], schema=STRIPS)


def _summed(batches, width: int):
    """Each strip, whose rows follow one another, with the sums of its cells."""
    strip, total = None, None
    for batch in batches:
        for s, cells, sums in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if s != strip:
                if strip is not None:
                    yield strip, total
                strip, total = s, np.zeros(STRIP * width)
            total[np.frombuffer(cells.as_buffer(), np.uint32)] += np.frombuffer(sums.as_buffer(), np.float32)
    if strip is not None:
        yield strip, total


def window_rows(parts: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the windows of some texts, of length 1: window, word and value, rising by window and word.

    A text is the array of its words' places, -1 for those that weigh nothing.  The k-th window
    begins with the k-th half; it takes the next half too, and a text of one half is one window.
    """
    sizes = np.array([len(p) for p in parts])
    counts = np.maximum(1, -(-sizes // HALF) - 1)
    base = np.cumsum(counts) - counts
    words = np.concatenate(parts)
    text = np.repeat(np.arange(len(parts)), sizes)
    half = (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // HALF
    at = np.flatnonzero(words >= 0)
    words, text, half = words[at], text[at], half[at]
    own, next_ = half < counts[text], half > 0  # words of a window's first and second half
    window = np.concatenate([(base[text] + half)[own], (base[text] + half - 1)[next_]])
    code, n = np.unique(window * len(weights) + np.concatenate([words[own], words[next_]]), return_counts=True)
    window, word = np.divmod(code, len(weights))
    x = n * weights[word].astype(np.float64)
    return window, word, x / np.sqrt(np.bincount(window, x * x))[window]


class PairSums:
    """Sums, over windows, of the products of the values of any two words; a pair stands once, in rising order."""

    def __init__(self, width: int):
        self.width, self.head = width, min(HEAD, width)
        self.table = np.zeros((self.head, self.head))
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, window: np.ndarray, word: np.ndarray, x: np.ndarray) -> None:
        """Rows as :func:`window_rows` gives them: each value with itself and with those after it in its window."""
        k = np.arange(len(word))
        for lag in range(2 * HALF):
            k = k[: np.searchsorted(k, len(word) - lag)]
            k = k[window[k + lag] == window[k]]
            if not len(k):
                break
            a, b, part = word[k], word[k + lag], x[k] * x[k + lag]
            far = b >= self.head
            if far.any():
                self.rest.append((a[far] * self.width + b[far], part[far]))
                a, b, part = a[~far], b[~far], part[~far]
            np.add.at(self.table.reshape(-1), a * self.head + b, part)

    def gathered(self, most: int = 0):
        """What the table does not hold, where that is more than ``most`` pairs."""
        if sum(len(code) for code, _ in self.rest) > most:
            code, part = (np.concatenate(c) for c in zip(*self.rest))
            self.rest = []
            code, place = np.unique(code, return_inverse=True)
            yield _strips(code, np.bincount(place, part), self.width)

    def all(self):
        yield from self.gathered()
        for start in range(0, self.head, STRIP):
            some = self.table[start : start + STRIP]
            a, b = np.nonzero(some)
            yield _strips((a + start) * self.width + b, some[a, b], self.width)


def pair_sums(docs: DataFrame, vocabulary: dict[bytes, int], weights: np.ndarray, text_col: str) -> DataFrame:
    """A'A of the matrix A of all windows of ``docs``, in strips of rows that follow one another.

    A row of A is a window's TF-IDF vector, of length 1.  Pairs of words are summed where the texts
    lie; sums then meet by strips, first each pair once, then in both orders.
    """
    width = len(vocabulary)
    held = docs.sparkSession.sparkContext.broadcast(({w: i for w, i in vocabulary.items() if weights[i] > 0}, weights))
    schema = "strip int, cells binary, sums binary"

    def run(batches):
        places, weights = held.value
        get = places.get
        sums, parts, n = PairSums(width), [], 0
        for batch in batches:
            for t in batch.column(0):
                found = np.array([get(w, -1) for w in words_of(t.as_py())], np.int64)
                for at in range(0, max(1, -(-len(found) // HALF) - 1), SLICE):
                    parts.append(found[at * HALF : (at + SLICE + 1) * HALF])
                    n += len(parts[-1])
                    if n >= FIT_WORDS:
                        sums.add(*window_rows(parts, weights))
                        parts, n = [], 0
                        yield from sums.gathered(PAIRS)
        if n:
            sums.add(*window_rows(parts, weights))
        yield from sums.all()

    def mirrored(batches):
        for strip, total in _summed(batches, width):
            cell = np.flatnonzero(total)
            code, sums = cell + strip * STRIP * width, total[cell]
            yield _strips(code, sums, width)
            a, b = np.divmod(code, width)
            off = np.flatnonzero(a < b)
            off = off[np.argsort(b[off], kind="stable")]
            yield _strips(b[off] * width + a[off], sums[off], width)

    def whole(batches):
        for strip, total in _summed(batches, width):
            cell = np.flatnonzero(total)
            yield _strips(cell + strip * STRIP * width, total[cell], width)

    tasks = max(FIT_TASKS, 4 * docs.sparkSession.sparkContext.defaultParallelism)
    out = docs.select(F.col(text_col).alias("text")).coalesce(tasks).mapInArrow(run, schema)
    for meet in (mirrored, whole):
        out = out.repartition("strip").sortWithinPartitions("strip").mapInArrow(meet, schema)
    return out


def randomised_svd(sums: DataFrame, extra: np.ndarray, width: int, rank: int, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors (width x rank) of a sparse matrix A, given A'A by :func:`pair_sums`.

    ``extra`` are further rows of the same matrix, kept on the driver (the items).  Each round the
    tasks multiply their strips of A'A with Q, and the driver orthogonalises a matrix of
    width x (rank + oversampling).
    """
    spark = sums.sparkSession
    size = min(width, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((width, size)))[0].astype(np.float32)
    for _ in range(rounds + 1):
        held = spark.sparkContext.broadcast(q)

        def run(batches, held=held):
            for strip, total in _summed(batches, width):
                made = total.reshape(STRIP, width).astype(np.float32) @ held.value
                yield pa.RecordBatch.from_arrays(
                    [pa.array([strip * STRIP], pa.int64()), pa.array([made.tobytes()], pa.binary())], ["start", "part"]
                )

        y = np.zeros((width, size), np.float32)
        for r in sums.mapInArrow(run, "start long, part binary").collect():
            some = y[r["start"] : r["start"] + STRIP]
            some[:] = np.frombuffer(r["part"], np.float32).reshape(STRIP, size)[: len(some)]
        y += extra.T @ (extra @ q)
        before, q = q, np.linalg.qr(y)[0].astype(np.float32)
    # Rayleigh-Ritz in the last subspace orders the directions by their singular values.
    values, vectors = np.linalg.eigh(before.T @ y)
    order = np.argsort(-values)[:rank]
    return (before @ vectors[:, order]).astype(np.float32)


def build_index(docs: DataFrame, passages: list[Passage], text_col: str) -> LatentIndex:
    """The space of a block of passages, fitted on all windows of ``docs`` and the passages."""
    vocabulary: dict[bytes, int] = {}
    for p in passages:
        for w in p.words:
            vocabulary.setdefault(w, len(vocabulary))
    df, n_docs, n_windows = document_frequencies(docs, vocabulary, text_col)
    weights = word_weights(df, n_docs, passages, vocabulary)
    width = len(vocabulary)
    dense = np.zeros((len(passages), width), np.float32)
    for k, p in enumerate(passages):
        for w in p.words:
            dense[k, vocabulary[w]] += weights[vocabulary[w]]
    norms = np.linalg.norm(dense, axis=1, keepdims=True)
    dense /= np.maximum(norms, 1e-9)

    sums = pair_sums(docs, vocabulary, weights, text_col).persist()
    try:
        # The passages outweigh all windows together, so their directions come first.
        heavy = np.float32(np.sqrt(max(HEAVY, 10.0 * n_windows)))
        basis = randomised_svd(sums, heavy * dense, width, min(RANK + len(passages), width))
    finally:
        sums.unpersist()
    vectors = (dense @ basis) * norms
    lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
    vectors /= lengths[:, None]
    bars = SLACK * least_parts(passages, {w: float(weights[i]) for w, i in vocabulary.items()})
    some = [(w, i) for w, i in vocabulary.items() if weights[i] > 0]
    placed = {w: k for k, (w, _) in enumerate(some)}
    table = (basis * weights[:, None])[[i for _, i in some]]
    return LatentIndex(placed, table, passages, vectors.astype(np.float32), lengths, np.maximum(bars, 1e-6))


FOUND = T.StructType(
    [
        T.StructField("item", T.LongType()),
        T.StructField("cosine", T.DoubleType()),
        T.StructField("lcs", T.DoubleType()),
        T.StructField("answer", T.DoubleType()),
    ]
)


def search_texts(texts: list[str | None], index: LatentIndex) -> list[list[dict]]:
    """For each text the items it holds, each with its best figures."""
    get = index.vocabulary.get
    out: list[list[dict]] = [[] for _ in texts]
    best: dict[tuple[int, int], dict] = {}
    for d, t in enumerate(texts):
        words = words_of(t)
        if not words:
            continue
        ids = np.array([get(x, -1) for x in words], np.int64)
        # Words are projected on the passages once for all, so a region's parts are sums over its words.
        along = _regions(_quarter_parts(ids, index), len(words))
        for r, p in zip(*np.nonzero(along >= (1 - FAINT) * index.bars)):
            start, passage = int(r) * HALF, index.passages[p]
            region = slice(max(0, start - QUARTER), start + 2 * HALF + QUARTER)
            share, answer = passage.verify(words[region])
            if share < LOOSE:
                continue
            vector = index.region(ids[region])
            part = (vector[None] @ index.vectors.T)[0, p]
            if part >= index.bars[p] and passage.accepts(share, answer, float(part / index.lengths[p])):
                norm = np.linalg.norm(vector[None], axis=1)[0]
                near, key = float(part / norm), (d, passage.item)
                if key not in best or (share, near) > (best[key]["lcs"], best[key]["cosine"]):
                    best[key] = {"item": passage.item, "cosine": near, "lcs": share, "answer": answer}
    for (d, _), hit in sorted(best.items()):
        out[d].append(hit)
    return out


def search(docs: DataFrame, index: LatentIndex, text_col: str = "text") -> DataFrame:
    """``docs`` with ``found``, the benchmark items each text holds."""
    kept = [f for f in docs.schema if f.name != "found"]
    schema = T.StructType([*kept, T.StructField("found", T.ArrayType(FOUND))])
    held = docs.sparkSession.sparkContext.broadcast(index)

    def body():
        index = held.value

        def kernel(batch):
            out = {f.name: batch.column(f.name) for f in kept}
            return out | {"found": search_texts(batch.column(text_col).to_pylist(), index)}

        return kernel

    return map_rows(docs.select(*[F.col(f"`{f.name}`") for f in kept]), body, schema)


def _one_an_item(found: Column) -> Column:
    """Of several findings of an item the one with the most words in order."""
    ranked = F.array_sort(
        F.transform(found, lambda x: F.struct(x["item"].alias("item"), (-x["lcs"]).alias("less"), (-x["cosine"]).alias("far"), x["answer"].alias("answer")))
    )
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["item"] != x["item"]))
    back = lambda x: F.struct(x["item"].alias("item"), (-x["far"]).alias("cosine"), (-x["less"]).alias("lcs"), x["answer"].alias("answer"))
    return let(ranked, lambda all_: F.transform(first(all_), back))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_passages: int = BLOCK_PASSAGES,
) -> DataFrame:
    """``docs`` with ``found``: the items (item, cosine, lcs, answer) that each text holds.

    A null or empty text holds none; so does every text where the benchmark is empty.  Items
    without a word and without an id find nothing.  Rows, repeated ones too, and columns stay; an
    input column named ``found`` is replaced.  Texts of any length are searched whole; an item that
    is longer than a window counts when one of its parts is found, and its parts may lie in two
    blocks.  Equal items are all reported.  Ids of items are whole numbers.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter(
        "item IS NOT NULL AND text IS NOT NULL"
    )
    out = docs.drop("found").withColumn("found", F.array().cast(T.ArrayType(FOUND)))
    block: list[Passage] = []
    blocks = 0

    def look(out: DataFrame) -> DataFrame:
        before = out.withColumnRenamed("found", "__before")
        found = search(before, build_index(docs, block, text_col), text_col)
        merged = F.concat("__before", "found")
        return found.withColumn("found", _one_an_item(merged) if blocks else merged).drop("__before")

    for row in items.orderBy("item", "text").toLocalIterator():
        for passage in passages_of(row["item"], row["text"]):
            if len(block) == block_passages:
                out, block, blocks = look(out), [], blocks + 1
            block.append(passage)
    return look(out) if block else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    renamed, back = set_aside(docs, ("found",))
    return back(contaminated(renamed, benchmark).filter(F.size("found") == 0))
