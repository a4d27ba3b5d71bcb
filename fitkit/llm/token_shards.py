"""Training-order materialisation: token sequences in permuted slots of fixed-stride shards.

Documents are tokenised and dealt to buckets by a hash of id and text; inside a bucket their
tokens stand in id order, one after the other, and are cut into sequences of one length.  With
the sizes of all buckets every sequence has a dense index, whatever the layout of the input.  A
keyed Feistel permutation with cycle-walking turns the index into a global slot, and ranges of
slots are written as shards: record k of a shard starts at byte k * stride, so a reader can
resume at any slot by a seek.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import map_rows
from fitkit.session import scratch_path

BUCKETS = 256
BUCKET_ROWS = 100_000
SEQUENCE = 512
SHARD_SLOTS = 16384
ROUNDS = 6
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
DTYPE = "<u2"
#: Compression of token frames on their way: a tenth smaller than at level 3 for a few CPU seconds a GB.
LEVEL = 5


class SlotPermutation:
    """A keyed permutation of 0 .. n-1 on arrays; ``inverse`` finds what stands in a slot."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        base = key * 0x9E3779B97F4A7C15
        self.keys = [np.uint64((base + r * 0xBF58476D1CE4E5B9) % (1 << 64)) for r in range(ROUNDS)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = x + key
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _walk(self, index: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        out = np.array(index, np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> self.half, out[todo] & self.mask
            for key in keys:
                left, right = right, left ^ self._mix(right, key)
            out[todo] = right << self.half | left
            todo = todo[out[todo] >= self.n]  # outside the range: walk on
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def inverse(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def byte_bpe(ranks_file: str, pattern: str) -> Callable[[], Callable[[str], bytes]]:
    """Packed ids of a text by a byte-level BPE vocabulary of ranks."""

    def make():
        import base64
        from array import array

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if len(ranks) > 1 << 16:
            raise ValueError("ids don't fit into two bytes")
        model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def tokens(text: str) -> bytes:
            return array("H", model.encode_ordinary(text)).tobytes()

        return tokens

    return make


def _tokenised(
    docs: DataFrame,
    make,
    end_id: int,
    id_col: str,
    text_col: str,
    buckets: int,
    samples: list[bytes],
) -> DataFrame:
    """``bucket, doc_id, tie, n`` and ``ids``, packed and compressed.

    ``tie`` orders rows that share an id.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"),
        F.col(id_col).cast("long").alias("doc_id"),
        key.alias("tie"),
        F.col(text_col).alias("text"),
    )
    fields = [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("tie", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]

    def body():
        tokens = make()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(samples))
        size = np.dtype(DTYPE).itemsize
        end = np.array([end_id], DTYPE).tobytes()

        def kernel(batch):
            made = [tokens(t.as_py()) + end for t in batch.column(3)]
            out = {k: batch.column(k) for k in ("bucket", "doc_id", "tie")}
            return out | {"n": [len(m) // size for m in made], "ids": [pack.compress(m) for m in made]}

        return kernel

    return map_rows(rows, body, T.StructType(fields))


def _samples(docs: DataFrame, make, text_col: str) -> list[bytes]:
    """Beginnings of some texts as packed ids, for the dictionary of the shuffles alone."""
    share = min(1.0, 1200 / max(1, docs.count()))
    drawn = docs.filter(F.col(text_col).isNotNull()).filter(
        F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30))
    )
    rows = drawn.select(F.substring(text_col, 1, 2000).alias("t")).limit(400).collect()
    tokens = make()
    return [tokens(r["t"]) for r in rows]


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """What short frames may refer to; without it they compress a tenth less."""
    held = b"".join(samples)[: 400 << 10]
    return zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(held) >= 8 else None


def materialise(
    docs: DataFrame,
    make: Callable[[], Callable[[str], bytes]],
    *,
    path: str | None = None,
    key: int = 20240229,
    sequence: int = SEQUENCE,
    shard_slots: int = SHARD_SLOTS,
    buckets: int | None = None,
    end_id: int,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write shards ``shard-NNNNNN.bin`` below ``path`` and return one row for each sequence.

    ``make`` runs in each task and gives the tokenizer, a function from a text to packed ids.

    Rows: ``slot, shard, record, seq, bucket, n_tokens, first_doc, n_docs, crc``.  The files are
    written while the rows are computed; a task that runs again writes the same bytes under a
    new name and moves them into place.  ``path`` is a URI that all executors reach; without one
    a folder beside the checkpoints is taken.

    Null texts have no tokens and are left out; an empty text is its end token.  Rows that repeat
    an id stand in the order of a hash of their text, exact repeats one after the other; a null
    id stands first.  An empty table gives no shard and no row.  Only the last sequence of a bucket
    is padded (id ``pad_id``; ``n_tokens`` has its length).  Long texts fill as many sequences as
    they need.  The number of buckets is part of the order, so fix it for a corpus; without one it
    grows with the documents, by powers of two from ``BUCKETS`` on, so that about ``BUCKET_ROWS`` meet.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = max(BUCKETS, 1 << max(0, docs.count() // BUCKET_ROWS - 1).bit_length())
    root = path or scratch_path(spark, "shards")
    samples = _samples(docs, make, text_col)
    record = sequence * np.dtype(DTYPE).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket come sorted: cut their tokens into sequences."""
        shared = _dictionary(samples)
        unpack = zstandard.ZstdDecompressor(dict_data=shared)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        at = {"bucket": None}

        def sequences(rows, last: bool):
            out = {k: [] for k in kinds}

            def put(data: bytes):
                out["number"].append(at["number"])
                out["bucket"].append(at["bucket"])
                out["n_tokens"].append(len(data) // (record // sequence))
                out["first_doc"].append(at["first"])
                out["n_docs"].append(at["docs"])
                out["ids"].append(pack.compress(data + pad[len(data) :]))
                at["number"] += 1

            for bucket, doc, blob in rows:
                if bucket != at["bucket"]:
                    if at["bucket"] is not None and at["held"]:
                        put(bytes(at["held"]))
                    at.update(bucket=bucket, number=0, held=bytearray(), docs=0, first=None)
                data = unpack.decompress(blob)
                if not at["held"]:
                    at["first"], at["docs"] = doc, 0
                at["held"] += data
                at["docs"] += 1
                start = 0
                while len(at["held"]) - start >= record:
                    put(bytes(at["held"][start : start + record]))
                    start += record
                    at["first"], at["docs"] = doc, 1
                del at["held"][:start]
                if not at["held"]:
                    at["docs"] = 0
            if last and at["bucket"] is not None and at["held"]:
                put(bytes(at["held"]))
            return pa.RecordBatch.from_arrays([pa.array(out[k], type=t) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                yield sequences(zip(*(part.column(k).to_pylist() for k in ("bucket", "doc_id", "ids"))), False)
        yield sequences((), True)

    pad = np.full(sequence, pad_id, DTYPE).tobytes()
    kinds = {
        "number": pa.int64(),
        "bucket": pa.int32(),
        "n_tokens": pa.int32(),
        "first_doc": pa.int64(),
        "n_docs": pa.int32(),
        "ids": pa.binary(),
    }
    # Sizes and sequences come from one exchange, so that every text is tokenised once.
    tasks = _tasks(spark, buckets)
    dealt = _tokenised(docs, make, end_id, id_col, text_col, buckets, samples).repartitionById(
        tasks, F.col("bucket") % tasks
    )
    cuts = dealt.sortWithinPartitions("bucket", "doc_id", "tie").mapInArrow(
        cut, "number long, bucket int, n_tokens int, first_doc long, n_docs int, ids binary"
    )
    # One row for each bucket: the index of its first sequence, and how many there are in all.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        dealt.mapInArrow(_bucket_sizes, "bucket int, n long")
        .groupBy("bucket")
        .agg(F.ceil(F.sum("n") / sequence).alias("m"))
        .select(
            "bucket",
            F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"),
            F.sum("m").over(Window.orderBy("bucket").rowsBetween(*WHOLE)).alias("total"),
        )
    )

    @F.pandas_udf(T.LongType())
    def slot_of(seq: pd.Series, total: pd.Series) -> pd.Series:
        if not len(seq):
            return seq
        return pd.Series(SlotPermutation(int(total.iloc[0]), key).slot(seq.to_numpy(np.uint64)))

    # Ranges of slots: a partition holds neighbouring shards and writes them in order.
    tasks = _tasks(spark, 1 << 31)
    shard, shards = F.floor(F.col("slot") / shard_slots), F.ceil(F.col("total") / shard_slots)
    ranges = (
        cuts.join(F.broadcast(places), "bucket")
        .withColumn("seq", F.col("base") + F.col("number"))
        .withColumn("slot", slot_of("seq", "total"))
        .withColumn("range", F.floor(shard * tasks / shards).cast("int"))
        .select("slot", "seq", "bucket", "n_tokens", "first_doc", "n_docs", "ids", "range")
        .repartitionById(tasks, F.col("range"))
        .sortWithinPartitions("slot")
        .drop("range")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, unpack = ShardWriter(root), zstandard.ZstdDecompressor(dict_data=_dictionary(samples))
        for batch in batches:
            slots = batch.column(0).to_numpy()
            ids = batch.column(6)
            shard, place = slots // shard_slots, slots % shard_slots
            crc = []
            for k, data in enumerate(ids):
                data = unpack.decompress(data.as_py())
                writer.put(int(shard[k]), data)
                crc.append(zlib.crc32(data))
            columns = [batch.column(k) for k in (1, 2, 3, 4, 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shard), pa.array(place), *columns, pa.array(crc, pa.int64())],
                [f.name for f in ROW_SCHEMA],
            )
        writer.close()

    return ranges.mapInArrow(write, ROW_SCHEMA)


def _bucket_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens by bucket.  It takes whole rows, for an exchange of fewer columns would be another one."""
    sizes: dict[int, int] = {}
    for batch in batches:
        for bucket, n in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist()):
            sizes[bucket] = sizes.get(bucket, 0) + n
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sizes), pa.int32()), pa.array(list(sizes.values()), pa.int64())], ["bucket", "n"]
    )


ROW_SCHEMA = T.StructType(
    [
        T.StructField("slot", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("record", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("first_doc", T.LongType()),
        T.StructField("n_docs", T.IntegerType()),
        T.StructField("crc", T.LongType()),
    ]
)


def _tasks(spark, pieces: int) -> int:
    """As many tasks as the session shuffles into, and not more than there are pieces."""
    return max(1, min(pieces, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def file_system(root: str):
    """The file system of a URI and the path in it (local, s3, gs, hdfs as pyarrow knows them)."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


class ShardWriter:
    """Writes records to one shard after the other; a whole file is moved into place."""

    def __init__(self, root: str):
        self.fs, self.root = file_system(root)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.out, self.held = None, None, ""

    def put(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard = shard
            self.held = f"{self.root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.held)
        self.out.write(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.held, f"{self.root}/{shard_name(self.shard)}")
            self.out = None


def read_slots(root: str, first: int, count: int, sequence: int = SEQUENCE, shard_slots: int = SHARD_SLOTS) -> np.ndarray:
    """Tokens of ``count`` slots from ``first`` on, as rows: a seek and a sequential read."""
    fs, path = file_system(root)
    record = sequence * np.dtype(DTYPE).itemsize
    parts = []
    while count > 0:
        shard, place = divmod(first, shard_slots)
        take = min(count, shard_slots - place)
        with fs.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek(place * record)
            data = f.read(take * record)
        parts.append(np.frombuffer(data, DTYPE).reshape(-1, sequence))
        first, count = first + take, count - take
    return np.concatenate(parts) if parts else np.empty((0, sequence), DTYPE)
