"""Encoding and decoding with a sentencepiece vocabulary over a relational lattice.

A text is cut into units at spaces, where no piece can cross.  The frequent units of the corpus
are encoded relationally: their substrings of bounded length are exploded and equi-joined to the
piece table, the matching edges are grouped by unit, and a higher-order aggregate folds Viterbi's
best path over them.  The result is a table of bounded size that is broadcast.  Units beyond it
are found where the documents lie, by the same recurrence over the same piece table; sending
them through a shuffle would move the whole text.

Segmentation takes the fewest pieces, and of those the largest sum of the scores in the vocabulary
file; of equal sums the one with the longer last piece wins.  Scores of a merge-based vocabulary are
ranks of merges: their sum alone would prefer many early pieces to few late ones.  Characters
without a piece fall back to bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import Scratch, map_rows, texts
from fitkit.llm.quality import let

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Bytes of the longest unit that is encoded side by side with others, units that are so at once, bytes
#: of text that a task works on at once, and units it remembers.
BATCH_LENGTH = 64
BATCH_UNITS = 16_384
PIECE_BYTES = 2 << 20
REMEMBERED = 100_000
#: Units in the broadcast table at most, and their longest length; together they bound its size.
TABLE_UNITS = 100_000
TABLE_LENGTH = 48
#: What a piece costs beside its score, and a character without one; scores are far smaller numbers.
PIECE_COST = 1e6
FALLBACK_COST = 1e9


@dataclass
class Pieces:
    """The piece table: text, id and score; ids of the 256 byte pieces; special ids."""

    score: dict[str, tuple[float, int]]
    by_id: list[str | int | None]  # text, byte value, or None for control pieces
    byte_ids: list[int]
    longest: int

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        score, by_id, byte_ids = {}, [], [0] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                by_id.append(int(piece[3:5], 16))
                byte_ids[by_id[-1]] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                by_id.append(None)
            else:
                by_id.append(piece)
                score[piece] = (model.get_score(i) - PIECE_COST, i)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in score):
            raise ValueError("a piece crosses a space or a line end; units can't be cut there")
        return cls(score, by_id, byte_ids, max(map(len, score)))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, s, i) for p, (s, i) in self.score.items()]
        return spark.createDataFrame(rows, "piece string, score double, id int")


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


# --- the relational lattice --------------------------------------------------------------


def count_units(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``unit, n`` over all documents; tasks add up their own units first."""

    def run(batches):
        seen: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    seen.update(UNIT.findall(normalise(t.as_py())))
                if len(seen) > 250_000:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "unit string, n long")
    return parts.groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(counts: DataFrame, most: int, longest: int) -> DataFrame:
    """The most frequent units, at most ``most`` of them.

    Counts fall into bins of a 64th of an octave; all units of the highest bins are taken, as many
    bins as hold at most ``most`` units together, whatever the size of the corpus.
    """
    level = F.floor(F.log2(F.col("n")) * 64)
    usable = counts.filter(F.length("unit") <= longest).withColumn("level", level)
    total, least = 0, None
    # At most 64 bins for each of 63 octaves.
    for row in usable.groupBy("level").agg(F.count("*").alias("units")).orderBy(F.desc("level")).collect():
        total += row["units"]
        if total > most:
            break
        least = row["level"]
    return usable.filter(F.lit(False) if least is None else F.col("level") >= least).select("unit")


def _byte_fallback(char: Column, byte_ids: list[int]) -> Column:
    table = F.array(*[F.lit(i) for i in byte_ids])
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(1), F.length(code), F.lit(2)),
        lambda i: F.get(table, F.conv(F.substring(code, i, 2), 16, 10).cast("int")),
    )


def edges_of(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, edges``: all pieces that fit into a unit, as sorted (end, start, score, ids)."""
    starts = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    cuts = starts.select(
        "unit",
        "start",
        F.explode(
            F.sequence(
                F.lit(1), F.least(F.lit(pieces.longest), F.length("unit") - F.col("start") + 1)
            )
        ).alias("size"),
    ).withColumn("piece", F.expr("substring(unit, start, size)"))
    found = cuts.join(F.broadcast(pieces.frame(units.sparkSession)), "piece", "left").filter(
        "id IS NOT NULL OR size = 1"
    )
    edge = F.struct(
        (F.col("start") + F.col("size") - 1).alias("end"),
        (F.col("start") - 1).alias("start"),
        F.coalesce("score", F.lit(-FALLBACK_COST)).alias("score"),
        F.when(F.col("id").isNotNull(), F.array("id"))
        .otherwise(_byte_fallback(F.col("piece"), pieces.byte_ids))
        .alias("ids"),
    )
    return found.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(edges: Column, length: Column) -> Column:
    """Ids of the best path: a forward fold over the edges, then a fold back along it."""
    none = F.struct(
        F.lit(float("-inf")).alias("score"),
        F.lit(0).alias("start"),
        F.array().cast("array<int>").alias("ids"),
    )
    begin = F.struct(
        F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.array().cast("array<int>").alias("ids")
    )

    def step(best: Column, e: Column) -> Column:
        reached = F.get(best, e["start"])["score"] + e["score"]
        # Edges of one end come with the longest piece first; only a better sum replaces it.
        return F.when(
            reached > F.get(best, e["end"])["score"],
            F.transform(
                best,
                lambda b, i: F.when(
                    i == e["end"],
                    F.struct(reached.alias("score"), e["start"].alias("start"), e["ids"].alias("ids")),
                ).otherwise(b),
            ),
        ).otherwise(best)

    def back(best: Column) -> Column:
        return F.aggregate(
            F.sequence(length, F.lit(1), F.lit(-1)),
            F.struct(length.alias("at"), F.array().cast("array<int>").alias("ids")),
            lambda a, i: F.when(
                a["at"] == i,
                F.struct(
                    F.get(best, i)["start"].alias("at"), F.concat(F.get(best, i)["ids"], a["ids"]).alias("ids")
                ),
            ).otherwise(a),
            lambda a: a["ids"],
        )

    start = F.concat(F.array(begin), F.array_repeat(none, length))
    return let(F.aggregate(edges, start, step), back)


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, ids`` of the best segmentation of every unit; units are not empty."""
    return edges_of(units, pieces).select("unit", viterbi(F.col("edges"), F.length("unit")).alias("ids"))


# --- units beyond the table ----------------------------------------------------------------


class LocalLattice:
    """The same recurrence for one unit at a time, linear in its length."""

    def __init__(self, pieces: Pieces):
        self.score = pieces.score
        self.byte_ids = pieces.byte_ids
        self.longest = pieces.longest
        self.begins = {p[:k] for p in pieces.score for k in range(1, len(p) + 1)}

    def encode(self, unit: str) -> list[int]:
        n = len(unit)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        score, begins, longest = self.score, self.begins, self.longest
        for start in range(n):
            here = best[start]
            single = False
            for end in range(start + 1, min(n, start + longest) + 1):
                part = unit[start:end]
                if part not in begins:
                    break
                got = score.get(part)
                if got is not None:
                    single = single or end == start + 1
                    # Starts rise, so the longest piece of an end comes first here too.
                    if here + got[0] > best[end]:
                        best[end] = here + got[0]
                        came[end] = (start, got[1])
            if not single and here - FALLBACK_COST > best[start + 1]:
                best[start + 1] = here - FALLBACK_COST
                came[start + 1] = (start, -1)
        out: list[int] = []
        at = n
        while at:
            start, i = came[at]
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in reversed(unit[start:at].encode("utf-8", "replace"))]
            at = start
        return out[::-1]


class Trie:
    """The pieces as a byte trie in one open-addressed table: a step is a look-up by node and byte."""

    BITS = 20
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: Pieces):
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[float, int]] = {}
        for piece, found in pieces.score.items():
            at = 0
            for byte in piece.replace(SPACE, " ").encode():
                at = nodes.setdefault((at, byte), len(nodes) + 1)
            ends[at] = found
        bits = max(self.BITS, (8 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.nodes = np.zeros(1 << bits, np.int32)
        self.probes = 1
        for (parent, byte), node in nodes.items():
            key = parent << 8 | byte
            slot, tries = (key * int(self.MIX) & (1 << 64) - 1) >> int(self.shift), 1
            while self.keys[slot] >= 0:
                slot, tries = (slot + 1) & (len(self.keys) - 1), tries + 1
            self.keys[slot], self.nodes[slot] = key, node
            self.probes = max(self.probes, tries)
        self.score = np.full(len(nodes) + 1, np.nan)
        self.id = np.full(len(nodes) + 1, -1, np.int32)
        for node, (score, i) in ends.items():
            self.score[node], self.id[node] = score, i

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there is none."""
        key = node << 8 | byte
        slot = ((key.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == key, self.nodes[slot], 0).astype(np.int64)
        for _ in range(self.probes - 1):
            open_ = np.flatnonzero((out == 0) & (self.keys[slot] >= 0))
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            hit = self.keys[slot[open_]] == key[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
        return out


class BatchLattice:
    """The recurrence of :class:`LocalLattice` for many units side by side, byte by byte.

    Starts rise over all units together, so sums are added and ties fall as for one unit.  Bytes
    inside a character are no starts.
    """

    def __init__(self, pieces: Pieces):
        self.trie = Trie(pieces)
        self.byte_ids = np.array(pieces.byte_ids, np.int32)

    def encode(self, units: list[bytes], width: str) -> list[bytes]:
        size = np.array([len(u) for u in units], np.int64)
        order = np.argsort(-size, kind="stable")
        lengths = size[order]
        data = np.frombuffer(b"".join(units[i] + b"\0" for i in order.tolist()), np.uint8).astype(np.int64)
        base = np.cumsum(lengths + 1) - lengths - 1
        best = np.full(len(data), -np.inf)
        best[base] = 0.0
        came_size, came_id = np.zeros(len(data), np.int64), np.zeros(len(data), np.int32)
        trie = self.trie
        n = len(units)
        for s in range(int(lengths[0]) if n else 0):
            while lengths[n - 1] <= s:
                n -= 1
            at = base[:n] + s
            live = np.flatnonzero(best[at] > -np.inf)
            at, end = at[live], (base[:n] + lengths[:n])[live]
            here = best[at]
            lead = data[at]
            char = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(at), bool)
            who, node, k = np.arange(len(at)), np.zeros(len(at), np.int64), 0
            while len(who):
                node = trie.step(node, data[at[who] + k])
                k += 1
                held = node > 0
                who, node = who[held], node[held]
                score = trie.score[node]
                piece = np.flatnonzero(~np.isnan(score))
                mine, to = who[piece], at[who[piece]] + k
                single[mine] |= char[mine] == k
                reached = here[mine] + score[piece]
                better = reached > best[to]
                to = to[better]
                best[to], came_size[to], came_id[to] = reached[better], k, trie.id[node[piece][better]]
                more = at[who] + k < end[who]
                who, node = who[more], node[more]
            alone = np.flatnonzero(~single)
            to = at[alone] + char[alone]
            back = here[alone] - FALLBACK_COST
            better = back > best[to]
            alone, to = alone[better], to[better]
            best[to] = back[better]
            for j in range(1, 5):
                some = alone[char[alone] >= j]
                spot = at[some] + j
                came_size[spot], came_id[spot] = 1, self.byte_ids[data[spot - 1]]
        # Back along the best paths, all units one piece at a time; then turned round.
        at, who = base + lengths, np.arange(len(units))
        rows, found = [], []
        while True:
            live = at > base[who]
            at, who = at[live], who[live]
            if not len(at):
                break
            rows.append(who)
            found.append(came_id[at])
            at = at - came_size[at]
        out = [b""] * len(units)
        if rows:
            turn = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            row, ids = np.concatenate(rows), np.concatenate(found).astype(width)
            sort = np.lexsort((-turn, row))
            packed, ends = ids[sort].tobytes(), np.cumsum(np.bincount(row, minlength=len(units))) * ids.itemsize
            first = 0
            for i, last in zip(order.tolist(), ends.tolist()):
                out[i] = packed[first:last]
                first = last
        return out


def raw_pieces(pieces: Pieces) -> np.ndarray:
    """The UTF-8 bytes of every id."""
    raw = np.empty(len(pieces.by_id), object)
    for i, p in enumerate(pieces.by_id):
        raw[i] = b"" if p is None else bytes([p]) if isinstance(p, int) else p.encode()
    return raw


def decoded(ids: np.ndarray, raw: np.ndarray) -> str:
    text = b"".join(raw[ids].tolist()).replace(SPACE.encode(), b" ")
    return text.removeprefix(b" ").decode("utf-8", "replace")


# --- documents -----------------------------------------------------------------------------


def cut_units(spaced: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts as one binary array over their joined bytes, and where each text's begin.

    A unit begins with a text, a run of spaces, a line end, or behind a line end; so it is a word with
    the spaces before it, a run of spaces, or a line end.
    """
    whole = b"".join(spaced)
    data = np.frombuffer(whole, np.uint8)
    starts = np.cumsum([0] + [len(t) for t in spaced])
    line, space = data == 10, data == 32
    begin = line | space
    begin[1:] &= ~(space[1:] & space[:-1])
    begin[1:] |= line[:-1]
    begin[starts[:-1][np.diff(starts) > 0]] = True
    spots = np.append(np.flatnonzero(begin), len(data)).astype(np.int32)
    buffers = [None, pa.py_buffer(spots), pa.py_buffer(whole)]
    units = pa.Array.from_buffers(pa.binary(), len(spots) - 1, buffers)
    return units, np.searchsorted(spots[:-1], starts)


def joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a binary array without offset, one value behind the other, and where values begin."""
    if not len(column):
        return b"", np.zeros(1, np.int32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[: len(column) + 1]
    return (column.buffers()[2].to_pybytes()[: ends[-1]] if ends[-1] else b""), ends


def spoken_pieces(pieces: Pieces) -> pa.Array:
    """What each id stands for in a text that has spaces as spaces."""
    return pa.array([p.replace(SPACE.encode(), b" ") for p in raw_pieces(pieces)], pa.binary())


def restored(ids: np.ndarray, cuts: np.ndarray, raw: pa.Array, spaced: list[bytes]) -> list[bool]:
    """Whether the pieces of each text, from id ``cuts[i]`` on, join to the text again, byte by byte."""
    flat, ends = joined(raw.take(pa.array(ids)))
    ends = ends[cuts]
    return [flat[a:b] == t for a, b, t in zip(ends[:-1], ends[1:], spaced)]


class UnitIds:
    """The packed ids of units: from the table, from those met before, or from the lattice."""

    def __init__(self, pieces: Pieces, table: dict[bytes, bytes], width: str):
        self.table, self.width = table, width
        self.met: dict[bytes, bytes] = {}
        self.one, self.many = LocalLattice(pieces), BatchLattice(pieces)

    def of(self, units: list[bytes]) -> list[bytes]:
        table, met = self.table.get, self.met.get
        out = [table(u) or met(u) for u in units]
        new = [i for i, v in enumerate(out) if v is None]
        short = [i for i in new if len(units[i]) <= BATCH_LENGTH]
        for at in range(0, len(short), BATCH_UNITS):
            some = short[at : at + BATCH_UNITS]
            for i, v in zip(some, self.many.encode([units[i] for i in some], self.width)):
                out[i] = v
        if len(self.met) + len(short) > REMEMBERED:
            self.met.clear()
        self.met.update((units[i], out[i]) for i in short[:REMEMBERED])
        for i in new:
            if out[i] is None:
                unit = units[i].decode("utf-8", "replace").replace(" ", SPACE)
                out[i] = np.array(self.one.encode(unit), self.width).tobytes()
        return out


class Codec:
    """A vocabulary with the encoded frequent units of a corpus, shipped to all executors."""

    def __init__(self, spark: SparkSession, pieces: Pieces, table: dict[bytes, bytes]):
        self.width = "<u2" if len(pieces.by_id) <= 1 << 16 else "<u4"
        self.item_bytes = np.dtype(self.width).itemsize
        self.held = spark.sparkContext.broadcast((pieces, table))

    @classmethod
    def fit(
        cls,
        docs: DataFrame,
        model_file: str,
        text_col: str = "text",
        units: int = TABLE_UNITS,
        longest: int = TABLE_LENGTH,
    ) -> Codec:
        """Count the units of all documents and encode the frequent ones relationally."""
        spark = docs.sparkSession
        pieces = Pieces.load(model_file)
        scratch = Scratch(spark, "pieces")
        # A unit that stands once gains nothing from the table.
        counts = scratch.keep(count_units(docs, text_col).filter("n > 1"))
        hot = scratch.keep(frequent_units(counts, units, longest))
        width = "<u2" if len(pieces.by_id) <= 1 << 16 else "<u4"
        # At most ``units`` rows of at most ``longest`` characters.
        rows = encode_units(hot, pieces).toArrow()
        table = {
            u.replace(SPACE, " ").encode(): np.array(ids, width).tobytes()
            for u, ids in zip(rows.column("unit").to_pylist(), rows.column("ids").to_pylist())
        }
        return cls(spark, pieces, table)

    def encode(
        self, docs: DataFrame, text_col: str = "text", packed: bool = False, verify: bool = False
    ) -> DataFrame:
        """``docs`` with ``ids``, an array of int, or with ``packed`` its little-endian bytes.

        With ``verify`` a column ``restored`` tells whether decoding the ids gives the text again.
        A null text has null ids, an empty one none; both are restored.  Rows, repeated ones too,
        and other columns stay; input columns named ``ids`` or ``restored`` are replaced.  A text is
        encoded whole.
        """
        kept = [f for f in docs.schema if f.name not in ("ids", "restored")]
        kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
        fields = [*kept, T.StructField("ids", kind)]
        if verify:
            fields.append(T.StructField("restored", T.BooleanType()))
        schema = T.StructType(fields)
        held, width = self.held, self.width

        def body():
            pieces, table = held.value
            lookup = UnitIds(pieces, table, width)
            raw = spoken_pieces(pieces)
            item = np.dtype(width).itemsize

            def kernel(batch):
                found = texts(batch, text_col)
                spaced = [b" " + t.replace(SPACE.encode(), b" ") if t else b"" for t in found]
                units, first = cut_units(spaced)
                encoded = units.dictionary_encode()
                made = pa.array(lookup.of(encoded.dictionary.to_pylist()), pa.binary()).take(encoded.indices)
                flat, ends = joined(made)
                cuts = ends[first]
                out = {f.name: batch.column(f.name) for f in kept}
                if verify:
                    out["restored"] = restored(np.frombuffer(flat, width), cuts // item, raw, spaced)
                ids = [None if t is None else flat[a:b] for t, a, b in zip(found, cuts[:-1], cuts[1:])]
                if not packed:
                    ids = [None if m is None else np.frombuffer(m, width).astype(np.int32) for m in ids]
                return out | {"ids": ids}

            return kernel

        return map_rows(docs.select(*[F.col(f"`{f.name}`") for f in kept]), body, schema, PIECE_BYTES)

    def decode(self, rows: DataFrame, ids_col: str = "ids", to: str = "decoded", packed: bool = False) -> DataFrame:
        """``rows`` with the text of the ids in a column ``to``.

        Byte pieces join to UTF-8, control pieces give nothing, the space that encoding puts in
        front goes.  Null ids give null.  Decoding an encoded text gives the text itself, with any
        U+2581 in it as a space.
        """
        kept = [f for f in rows.schema if f.name != to]
        schema = T.StructType([*kept, T.StructField(to, T.StringType())])
        held, width = self.held, self.width

        def body():
            pieces, _ = held.value
            raw = raw_pieces(pieces)

            def one(ids) -> str:
                return decoded(np.frombuffer(ids, width) if packed else np.asarray(ids, np.int64), raw)

            def kernel(batch):
                ids = batch.column(ids_col).to_pylist()
                out = {f.name: batch.column(f.name) for f in kept}
                return out | {to: [None if i is None else one(i) for i in ids]}

            return kernel

        return map_rows(rows.select(*[F.col(f"`{f.name}`") for f in kept]), body, schema)
