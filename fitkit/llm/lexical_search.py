"""Ranked lexical search: presence masks group the documents of an item, best masks first.

A document's score for an item adds up, over the item's terms it holds, the term's weight times a
saturating function of its occurrences and the document's length, all in whole numbers.

Texts are read once: a document becomes the list of the asked terms it holds (its postings).  Postings
are then searched where they lie, block by block.  For every item a document's mask has one bit for each
term of the item, set by bit operations along the postings of that term, and documents of equal masks
are one group.  No document of a group scores more than the mask's terms at the best value that any
document of the block gives them.  Groups are evaluated from the highest such bound down, until the
next bound lies below the ``top``-th best score that the task has seen: what is left cannot enter the
result.  Every task gives its best ones; the best of these are the answer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import Scratch, texts

TOP = 10
#: Bytes of item text that are searched for at once; their terms are sent to all tasks.
BLOCK_BYTES = 2 << 20
#: Bytes of text or postings that a task works on at once.
PIECE_BYTES = 8 << 20

#: Digits, a-z, A-Z in lower case, and every byte of a character beyond ASCII; all else separates.
_TERM = bytes(
    c if c >= 128 or chr(c).islower() or chr(c).isdigit() else c + 32 if chr(c).isupper() else 32 for c in range(128)
) + bytes(range(128, 256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of letters, digits and characters beyond ASCII."""
    return text.translate(_TERM).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``100 - 90 + (90 * n * n_docs) div n_terms``; beyond 64 bits in Python's whole numbers."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(len(batch) * min(1.0, PIECE_BYTES / max(1, batch.nbytes))))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def postings(docs: DataFrame, asked: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tf`` of every document with a term: all its terms, and the asked ones it holds."""
    held = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        number = held.value.get
        for batch in _pieces(batches):
            spots, sizes, terms, tf = [], [], [], []
            for i, text in enumerate(texts(batch, 1)):
                words = terms_of(text)
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                which = np.fromiter(found, np.int64, len(found))
                order = np.argsort(which)
                spots.append(i)
                sizes.append(len(words))
                terms.append(which[order])
                tf.append(np.fromiter(found.values(), np.int64, len(found))[order])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(spots, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    _lists(terms, pa.int32()),
                    _lists(tf, pa.int64()),
                ],
                ["doc_id", "n", "terms", "tf"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Best:
    """The best ``top`` documents of one item that a task has seen: scores, null marks, ids."""

    def __init__(self, top: int):
        self.top = top
        self.rows = np.empty((3, 0), np.int64)

    @property
    def bar(self) -> int:
        """A group whose bound is below this holds nothing for the result."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.top else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        able = score >= self.bar
        rows = np.concatenate([self.rows, np.stack([score[able], none[able], ids[able]])], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.top]]


class Piece:
    """Postings of some documents by term, with the value that each adds to a score."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        lists, counts = batch.column(2), batch.column(3)
        size = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = counts.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(batch)), size)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        m = length_factor(n, n_docs, n_terms)[doc]
        value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        order = np.argsort(term, kind="stable")
        self.size = len(batch)
        self.doc, self.value = doc[order], value[order]
        self.present, self.start = np.unique(term[order], return_index=True)
        self.end = np.r_[self.start[1:], len(term)]
        self.most = np.maximum.reduceat(self.value, self.start) if len(term) else self.value
        ids = batch.column(0)
        self.none = np.asarray(ids.is_null()).astype(np.int64)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Add this piece's best documents for the terms of an item; how many were evaluated."""
        at = np.searchsorted(self.present, terms)
        inside = at < len(self.present)
        at = at[inside]
        at = at[self.present[at] == terms[inside]]
        if not len(at) or int(self.most[at].sum()) < best.bar:
            return 0
        masks = np.zeros((self.size, (len(at) + 63) // 64), np.uint64)
        for j, t in enumerate(at):
            masks[self.doc[self.start[t] : self.end[t]], j // 64] |= np.uint64(1 << (j % 64))
        touched = np.flatnonzero(masks.any(axis=1))
        if masks.shape[1] == 1:
            distinct, group = np.unique(masks[touched, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, group = np.unique(masks[touched], axis=0, return_inverse=True)
        bound = np.zeros(len(distinct), np.int64)
        for j, t in enumerate(at):
            held = distinct[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)
            bound += held.astype(np.int64) * self.most[t]
        # Documents stand by group, the groups by falling bound.
        place = np.empty(len(distinct), np.int64)
        falling = np.argsort(-bound, kind="stable")
        place[falling] = np.arange(len(distinct))
        rank = place[group.ravel()]
        order = np.argsort(rank, kind="stable")
        members, ends = touched[order], np.cumsum(np.bincount(rank, minlength=len(distinct)))
        done, first, wanted = 0, 0, best.top
        while first < len(distinct) and bound[falling[first]] >= best.bar:
            able = int(np.searchsorted(-bound[falling], -best.bar, side="right"))
            last = min(able, 1 + int(np.searchsorted(ends, done + wanted)))
            last = max(last, first + 1)
            some = np.sort(members[done : ends[last - 1]])
            score = np.zeros(len(some), np.int64)
            for t in at:
                docs = self.doc[self.start[t] : self.end[t]]
                spot = np.searchsorted(docs, some)
                spot[spot == len(docs)] = 0
                hit = docs[spot] == some
                score[hit] += self.value[self.start[t] + spot[hit]]
            best.add(score, self.none[some], self.ids[some])
            done, first, wanted = int(ends[last - 1]), last, 2 * wanted
        return done


def _search_block(
    docs: DataFrame, block: list[tuple[object, bytes]], item_type: T.DataType, top: int, scratch: Scratch, id_col: str, text_col: str
) -> DataFrame:
    """``item, item_id, doc_id, score``: each task's best documents for each item of a block."""
    spark = docs.sparkSession
    asked: dict[bytes, int] = {}
    items = []
    for item_id, text in block:
        numbers = sorted({asked.setdefault(t, len(asked)) for t in terms_of(text)})
        items.append((item_id, np.array(numbers, np.int64)))
    found = scratch.keep(postings(docs, asked, id_col, text_col))
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total["docs"], total["terms"] or 0
    weights = np.zeros(len(asked), np.int64)
    # One row for each asked term at most.
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r["t"]] = weight(n_docs, r["count"])
    held = spark.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = held.value
        best = [Best(top) for _ in items]
        for batch in _pieces(batches):
            piece = Piece(batch, weights, n_docs, n_terms)
            for (_, terms), kept in zip(items, best):
                piece.search(terms, kept)
        which = np.repeat(np.arange(len(items)), [b.rows.shape[1] for b in best])
        rows = np.concatenate([b.rows for b in best], axis=1) if best else np.empty((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(which, pa.int64()),
                pa.array([items[i][0] for i in which], type=kind),
                pa.array(rows[2], pa.int64(), mask=rows[1].astype(bool)),
                pa.array(rows[0], pa.int64()),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    schema = T.StructType(
        [
            T.StructField("item", T.LongType()),
            T.StructField("item_id", item_type),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(item_type)
    return found.filter(F.size("terms") > 0).mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item.

    Every row of ``items`` is asked by itself, also when an id repeats; a null or empty text asks for
    nothing.  Every row of ``docs`` is a document, repeated ones too; null texts hold no term.  Ids of
    documents are whole numbers; equal scores rank by id, null ids last.  Documents with score 0 (or
    none, or an empty table) give no row.  Texts of any length are read whole; other columns are not
    read.  Items are asked in blocks of ``block_bytes`` of text (a longer item by itself); every block
    reads all documents.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    item_type = items.schema[item_col].dataType
    rows = items.select(F.col(item_col), F.col(item_text_col).cast("string").cast("binary"))
    parts, block, size = [], [], 0

    def ask():
        found = _search_block(docs, block, item_type, top, scratch, id_col, text_col)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        parts.append(ranked.select("item_id", "rank", "doc_id", "score"))

    for item_id, text in rows.toLocalIterator():
        if block and size + len(text or b"") > block_bytes:
            ask()
            block, size = [], 0
        block.append((item_id, bytes(text or b"")))
        size += len(text or b"")
    if block:
        ask()
    if not parts:
        schema = T.StructType(
            [
                T.StructField("item_id", item_type),
                T.StructField("rank", T.IntegerType()),
                T.StructField("doc_id", T.LongType()),
                T.StructField("score", T.LongType()),
            ]
        )
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
