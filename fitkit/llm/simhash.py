"""SimHash near-duplicates through a Gray-ordered hierarchical Hamming index.

Every document gets a 64-bit fingerprint of its word shingles; fingerprints that
differ in at most three bits are linked, and linked documents form components.

The search works on distinct fingerprints.  A *node* of the index is a set of
fingerprints that share the bits under a mask.  The root is cut into four nodes per
fingerprint, one for each quarter of the bits: two fingerprints that differ in at most
three bits agree on at least one quarter, so no link is lost.  A node with too many
members is cut in the same way along its free bits, as often as needed; since members
are distinct, a node with f free bits never has more than 2**f of them, and the cutting
ends.  Inside a node members are sorted by Gray rank and grouped sixteen by sixteen into
upper nodes that hold the bits all members share; a pair of upper nodes whose shared bits
already differ in more than three places is pruned with everything below it.  A node gives a
spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitkit.llm.common import Scratch, map_rows, texts
from fitkit.llm.components import connected_components

#: A node with more members than this is cut along its free bits.
NODE_ROWS = 8192
FANOUT = 16
PAIR_BLOCK = 1 << 20


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text; 0 when it has no word.

    A-Z are lower-cased, words are split at ASCII white space.  A bit is set when more than
    half of the shingle hashes (XXH64, seed 42, repeats included) have it.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3):
    """``doc_id, row, fp`` for every document.

    ``fp`` is the fingerprint as a signed long, ``row`` a hash of id and text.
    """

    def body():
        def kernel(batch):
            fps = np.array([fingerprint_of(t, shingle) for t in texts(batch, 2)], np.uint64)
            return {"doc_id": batch.column(0), "row": batch.column(1), "fp": fps.view(np.int64)}

        return kernel

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "row", "fp")])
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col), F.col(text_col)
    )
    return map_rows(rows, body, schema)


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("row")


# --- nodes -----------------------------------------------------------------------------


def split_mask(mask: int) -> list[int]:
    """The four masks below ``mask``: its bits and one quarter of the free ones."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * k // 4 for k in range(5)]
    return [
        mask | sum(1 << b for b in free[cuts[k] : cuts[k + 1]])
        for k in range(4)
        if cuts[k] < cuts[k + 1]
    ]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_levels(node_rows: int) -> Iterator[dict[int, list[int]]]:
    """Masks by level, until no node can have more than ``node_rows`` members."""
    masks = [0]
    while masks:
        level = {m: split_mask(m) for m in masks}
        yield level
        below = {c for cs in level.values() for c in cs}
        masks = sorted(m for m in below if 1 << (64 - m.bit_count()) > node_rows)


def _into_nodes(rows: DataFrame, level: dict[int, list[int]]) -> DataFrame:
    """Deal every row of the nodes of a level to the nodes below.

    The table of masks depends on the level only, not on the data.
    """
    table = [(signed(mask), [signed(c) for c in cuts]) for mask, cuts in level.items()]
    masks = rows.sparkSession.createDataFrame(table, "mask long, cuts array<long>")
    return (
        rows.join(F.broadcast(masks), "mask")
        .select("fp", "rep", F.explode("cuts").alias("mask"))
        .withColumn("node", F.col("fp").bitwiseAND(F.col("mask")))
        .select("mask", "node", "fp", "rep")
    )


def links(distinct: DataFrame, scratch: Scratch, node_rows: int = NODE_ROWS) -> DataFrame:
    """``a, b``: links between representatives, one spanning forest per node of the index.

    ``distinct`` holds ``fp, rep``, one row per fingerprint.
    """
    open_rows = distinct.select("fp", "rep", F.lit(0).cast("bigint").alias("mask"))
    ready = []
    for level in mask_levels(node_rows):
        rows = _into_nodes(open_rows, level)
        sizes = rows.groupBy("mask", "node").count()
        # Almost always few or none: the test costs one small job and spares a level.
        large = scratch.keep(sizes.filter(F.col("count") > node_rows).select("mask", "node"))
        if large.isEmpty():
            ready.append(rows)
            break
        rows = scratch.keep(rows)
        ready.append(rows.join(large, ["mask", "node"], "left_anti"))
        open_rows = rows.join(large, ["mask", "node"], "left_semi")
    nodes = ready[0]
    for more in ready[1:]:
        nodes = nodes.unionByName(more)
    dealt = nodes.repartition("mask", "node").sortWithinPartitions(
        "mask", "node", gray_rank_column("fp")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return dealt.mapInArrow(_search_nodes, schema).distinct()


def gray_rank_column(name: str):
    """The Gray rank of a 64-bit code, with the sign bit flipped so that longs sort by it."""
    x = F.col(name)
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _search_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by node and Gray rank; a node may span batches."""
    held: list[np.ndarray] = []
    names = ("mask", "node", "fp", "rep")

    def work(rows: np.ndarray):
        pairs = forest(rows, *near_pairs(rows))
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        part = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
        held.append(part)
        rows = np.concatenate(held, axis=1)
        ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
        if len(ends) and rows.shape[1] >= 4096:
            yield work(rows[:, : ends[-1]])
            held = [rows[:, ends[-1] :]]
        else:
            held = [rows]
    if held and held[0].shape[1]:
        yield work(np.concatenate(held, axis=1))


def near_pairs(rows: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within a node at ``most`` or fewer bits, from upper nodes down.

    ``rows`` has mask, node, fp, rep; rows of a node stand together in Gray order.  Pairs
    within one node only; work is bounded by pruning and done in blocks.
    """
    fp = rows[2].view(np.uint64)
    new = np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(fp)])
    found_a, found_b = [], []

    def keep(a, b):
        close = np.bitwise_count(fp[a] ^ fp[b]) <= most
        found_a.append(a[close])
        found_b.append(b[close])

    # Small nodes: compare row i with row i + s while both lie in one node.
    small = sizes[group] <= FANOUT
    for s in range(1, FANOUT):
        a = np.flatnonzero(small[: len(fp) - s] & (group[: len(fp) - s] == group[s:]))
        if not len(a):
            break
        keep(a, a + s)
    for g in np.flatnonzero(sizes > FANOUT):
        for a, b in _descend(fp[starts[g] : starts[g] + sizes[g]], most):
            keep(a + starts[g], b + starts[g])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _descend(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of leaf pairs a < b that the upper nodes can't exclude."""
    patterns, shared = [fp], [np.full(len(fp), ~np.uint64(0))]
    while len(patterns[-1]) > FANOUT:
        p, m = patterns[-1], shared[-1]
        at = np.arange(0, len(p), FANOUT)
        all_and = np.bitwise_and.reduceat(p, at)
        all_or = np.bitwise_or.reduceat(p, at)
        same = ~(all_and ^ all_or) & np.bitwise_and.reduceat(m, at)
        patterns.append(all_and & same)
        shared.append(same)
    top = len(patterns) - 1
    n = len(patterns[top])
    stack = [(top, *np.triu_indices(n))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > PAIR_BLOCK:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        if level == 0:
            keep = a < b
            yield a[keep], b[keep]
            continue
        p, m = patterns[level], shared[level]
        far = np.bitwise_count((p[a] ^ p[b]) & m[a] & m[b])
        a, b = a[far <= most], b[far <= most]
        if not len(a):
            continue
        step = max(1, PAIR_BLOCK // (FANOUT * FANOUT))
        width = len(patterns[level - 1])
        kids = np.arange(FANOUT)
        for at in range(0, len(a), step):
            x = (a[at : at + step, None] * FANOUT + kids)[:, :, None]
            y = (b[at : at + step, None] * FANOUT + kids)[:, None, :]
            x, y = np.broadcast_arrays(x, y)
            x, y = x.ravel(), y.ravel()
            ok = (x < width) & (y < width) & (x <= y)
            stack.append((level - 1, x[ok], y[ok]))


def forest(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links of the pairs as stars around the smallest representative of each component."""
    rep = rows[3]
    label = rep.copy()
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if np.array_equal(before, label):
            break
    away = label != rep
    return np.unique(np.stack([rep[away], label[away]], axis=1), axis=0)


# --- the operator ----------------------------------------------------------------------

#: Representatives of classes whose rows all lack an id lie above every id.
NO_ID = 1 << 62


def _classes(fps: DataFrame, scratch: Scratch, node_rows: int) -> DataFrame:
    """``fp, component`` for every distinct fingerprint."""
    distinct = scratch.keep(
        fps.groupBy("fp")
        .agg(F.min("doc_id").alias("least"))
        .select("fp", F.coalesce("least", F.lit(NO_ID) + F.shiftrightunsigned("fp", 2)).alias("rep"))
    )
    edges = scratch.keep(links(distinct, scratch, node_rows))
    roots = connected_components(edges, scratch)
    return distinct.join(roots, distinct.rep == roots.id, "left").select(
        "fp", F.coalesce("root", "rep").alias("component")
    )


def simhash_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows keep
    their rows.  A row without id gets the component of its fingerprint; it never names one,
    and when no row of a component has an id the component is null.  An empty table gives an
    empty result.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    classes = _classes(fps, scratch, node_rows)
    return fps.join(classes, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"),
    )


#: Least values of a text's shingles under random maps, as many in a band; texts that agree on a band
#: are candidates.  At a similarity of 0.8 all bands differ with a probability of 0.0007, at 0.3 one
#: agrees with 0.02, at 0.2 with 0.0015.
BANDS = 24
BAND_ROWS = 6
#: Shingles mapped at once, and texts that are compared with one centre in one task.
MAP_ROWS = 2048
SALT_ROWS = 1024
#: Looks for a centre go on while this share of the compared texts joins one.
WORTH = 0.1
#: Texts and hashes of either side that are compared with each other at once, and columns of a product.
TILE_ROWS = 1024
TILE_HASHES = 1 << 20
TILE_COLUMNS = 4096

_MAPS = np.random.default_rng(64).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64)
_MAPS[1] |= np.uint64(1)


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; a shorter text is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), MAP_ROWS):
        mapped = (hashes[at : at + MAP_ROWS, None] ^ _MAPS[0]) * _MAPS[1]
        np.minimum(least, mapped.min(axis=0), out=least)
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, similar_shingle: int) -> DataFrame:
    """``doc_id, row, fp, sig, n, bands``: fingerprint, hash of the whole shingle set, its size, band keys."""

    def body():
        def kernel(batch):
            found = texts(batch, 2)
            fps = np.array([fingerprint_of(t, shingle) for t in found], np.uint64)
            sets = [shingle_set(t, similar_shingle) for t in found]
            sig = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
            return {
                "doc_id": batch.column(0),
                "row": batch.column(1),
                "fp": fps.view(np.int64),
                "sig": sig.view(np.int64),
                "n": [len(x) for x in sets],
                "bands": [band_keys(x) for x in sets],
            }

        return kernel

    long = T.LongType()
    schema = T.StructType(
        [T.StructField(n, long) for n in ("doc_id", "row", "fp", "sig", "n")] + [T.StructField("bands", T.ArrayType(long))]
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col), F.col(text_col))
    return map_rows(rows, body, schema)


def _shingle_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``row, hashes``: the whole shingle set of each row."""

    def body():
        def kernel(batch):
            return {
                "row": batch.column(0),
                "hashes": [shingle_set(t, shingle).tobytes() for t in texts(batch, 1)],
            }

        return kernel

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("hashes", T.BinaryType())])
    return map_rows(docs.select(row_key(id_col, text_col), F.col(text_col)), body, schema)


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of ``similar`` or more.

    The set of ``a`` travels once for each of its pairs and that of ``b``, the centre, once for each
    ``SALT_ROWS`` texts that are compared with it: a popular centre lies in many tasks.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("long").alias("parts"))
    left = (
        pairs.join(parts, "b")
        .select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("salt"), F.col("a").alias("row"))
        .join(sets, "row")
        .select("b", "salt", F.lit(1).alias("role"), "row", "hashes")
    )
    centres = (
        parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        .join(sets.withColumnRenamed("row", "b"), "b")
        .select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("row"), "hashes")
    )

    def run(batches):
        centre = None
        for batch in batches:
            a, b = [], []
            b_col, role, row, sets_col = (batch.column(i) for i in (0, 2, 3, 4))
            for i, (target, kind) in enumerate(zip(b_col.to_pylist(), role.to_pylist())):
                own = np.frombuffer(sets_col[i].as_buffer(), np.uint64)
                if kind == 0:
                    centre = own.copy()
                    continue
                common = len(np.intersect1d(centre, own, assume_unique=True))
                if common >= similar * (len(centre) + len(own) - common):
                    a.append(row[i].as_py())
                    b.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = left.unionAll(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", "role")
    return dealt.mapInArrow(run, "a long, b long")


def tiled_links(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """``a, b``: links between all texts of a bucket that lie in different components, as forests.

    ``members`` holds ``bucket, row, comp, n``.  Every text outside the largest component of its bucket is
    compared with all of other components there.  Both sides are dealt to blocks, and a task compares
    one block with another by matrix products, so a bucket of any size is spread over many tasks
    and no pair is a row.  A tile gives a spanning forest of its links, not all of them.
    """
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    whole = per.groupBy("bucket").agg(
        F.max(F.struct("rows", "n", "comp")).alias("most"), F.sum("rows").alias("rows"), F.sum("n").alias("n")
    )
    blocks = lambda rows, n: F.ceil(F.greatest(rows / TILE_ROWS, n / TILE_HASHES)).cast("long")
    plan = whole.select(
        "bucket",
        F.col("most.comp").alias("major"),
        blocks(F.col("rows") - F.col("most.rows"), F.col("n") - F.col("most.n")).alias("left"),
        blocks(F.col("rows"), F.col("n")).alias("right"),
    )
    placed = members.join(plan, "bucket")
    number = lambda of: F.pmod(F.xxhash64("row"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    names = ["bucket", "x", "y", "role", "row", "comp"]
    asking = placed.filter("comp <> major").select(
        "bucket", number("left").alias("x"), every("right").alias("y"), F.lit(0).alias("role"), "row", "comp"
    )
    asked = placed.select("bucket", every("left").alias("x"), number("right").alias("y"), F.lit(1).alias("role"), "row", "comp")
    rows = asking.unionAll(asked.select(*names)).join(sets, "row").select(*names, "hashes")

    def run(batches):
        key, held = None, []

        def leave():
            role, row, comp = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2))
            pairs = tile_links(role, row, comp, [h[3] for h in held], similar)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for i, found in enumerate(zip(*columns[:3])):
                if found != key:
                    if held:
                        yield leave()
                    key, held = found, []
                held.append((columns[3][i], columns[4][i], columns[5][i], np.frombuffer(batch.column(6)[i].as_py(), np.uint64)))
        if held:
            yield leave()

    dealt = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def tile_links(role: np.ndarray, row: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Links between sets of role 0 and of role 1 in different components: ``a, b`` rows of a forest."""
    size = np.array([len(x) for x in sets])
    _, spot, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = often[spot] > 1
    # Only hashes that stand twice make a common one; they get the numbers 0, 1, ...
    number = np.cumsum(often > 1) - 1
    owner, spot = owner[shared], number[spot[shared]]
    left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    place = np.empty(len(sets), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(spot, kind="stable")
    owner, spot = owner[order], spot[order]
    for low in range(0, int(spot[-1]) + 1 if len(spot) else 0, TILE_COLUMNS):
        part = slice(*np.searchsorted(spot, (low, low + TILE_COLUMNS)))
        who, column = owner[part], spot[part] - low
        sides = []
        for kind, n in ((0, len(left)), (1, len(right))):
            mine = role[who] == kind
            side = np.zeros((n, TILE_COLUMNS), np.float32)
            side[place[who[mine]], column[mine]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    union = size[left][:, None] + size[right] - common
    near = (common >= similar * union) & (comp[left][:, None] != comp[right])
    a, b = np.nonzero(near)
    # Components first, then the links between them: what is one component already stays one.
    names, label = np.unique(comp, return_inverse=True)
    reps = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(reps, label, row)
    rows = np.stack([reps, reps, reps, reps])
    return forest(rows, label[left[a]], label[right[b]])


def similar_classes(docs: DataFrame, sketches: DataFrame, labels: DataFrame, scratch: Scratch, similar: float, **columns) -> DataFrame:
    """``id, root``: the components of ``labels`` (``id, root``), joined where texts are similar.

    ``sketches`` holds ``row, n, bands`` of every distinct set.  Texts with a band in common are a bucket; only
    buckets with two or more components are looked at.  First a bucket elects a centre and every text takes
    the centre it meets in most buckets; those similar to it join its component, which settles buckets
    of copies without looking at their pairs.  That is repeated, with other centres, while it is worth it.
    At last every text outside the largest component of its bucket is compared with all of other
    components there.  So each candidate pair ends in one component or has been compared.
    """
    rooted = labels.select(F.col("id").alias("row"), F.col("root"))
    members, sets, turn, last = None, None, 0, False
    while True:
        # Bands are spread after their text is joined to its component: most buckets end here.
        placed = sketches if members is None else members
        placed = placed.join(rooted, "row", "left").withColumn("comp", F.coalesce("root", "row"))
        bucket = F.explode("bands").alias("bucket") if members is None else F.col("bucket")
        placed = placed.select(bucket, "row", "comp", "n")
        mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        members = scratch.keep(placed.join(mixed.select("bucket"), "bucket", "left_semi").distinct())
        if members.isEmpty():
            return labels
        if sets is None:
            asked = members.select("row").distinct()
            wanted = docs.select(columns["id_col"], columns["text_col"]).withColumn("row", row_key(columns["id_col"], columns["text_col"]))
            wanted = wanted.join(asked, "row", "left_semi")
            whole = _shingle_rows(wanted, columns["id_col"], columns["text_col"], columns["shingle"])
            sets = scratch.keep(whole.groupBy("row").agg(F.first("hashes").alias("hashes")))
        if last:
            found = scratch.keep(tiled_links(members, sets, similar))
        else:
            spot = F.struct(F.xxhash64("row", F.lit(turn)).alias("h"), "row", "comp")
            centres = members.groupBy("bucket").agg(F.min(spot).alias("c"))
            met = members.join(centres, "bucket").filter(F.col("comp") != F.col("c.comp"))
            met = met.groupBy(F.col("row").alias("a"), F.col("c.row").alias("b")).count()
            pairs = scratch.keep(met.groupBy("a").agg(F.max(F.struct("count", "b"))["b"].alias("b")))
            found = scratch.keep(verified(pairs, sets, similar))
        joined = found.count()
        if joined:
            edges = labels.select(F.col("id").alias("a"), F.col("root").alias("b")).union(found)
            labels = connected_components(edges, scratch)
            rooted = labels.select(F.col("id").alias("row"), F.col("root"))
        if last:
            return labels
        last = joined < WORTH * pairs.count()
        members, turn = members.drop("comp"), turn + 1


def _row_classes(
    docs: DataFrame, rows: DataFrame, scratch: Scratch, similar: float, node_rows: int, **columns
) -> DataFrame:
    """``doc_id, row, component`` by fingerprints, equal sets and similar sets."""
    by_print = scratch.keep(rows.groupBy("fp").agg(F.min("row").alias("rep")))
    by_set = scratch.keep(rows.groupBy("sig").agg(F.min("row").alias("rep")))
    stars = [
        rows.select(key, "row").join(reps, key).filter("row <> rep").select(F.col("row").alias("a"), F.col("rep").alias("b"))
        for key, reps in (("fp", by_print), ("sig", by_set))
    ]
    edges = scratch.keep(links(by_print, scratch, node_rows).union(stars[0]).union(stars[1]))
    labels = connected_components(edges, scratch)
    one = rows.select("row", "n", "bands").join(by_set.select(F.col("rep").alias("row")), "row", "left_semi")
    labels = similar_classes(docs, one, labels, scratch, similar, **columns)
    return rows.select("doc_id", "row").join(labels.select(F.col("id").alias("row"), "root"), "row", "left").select(
        "doc_id", "row", F.coalesce("root", "row").alias("component")
    )


def keep_first(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    node_rows: int = NODE_ROWS,
    similar: float | None = None,
    similar_shingle: int = 5,
) -> DataFrame:
    """One document of each component, with the columns of ``docs``.

    The one with the smallest id stays (any row with an id before rows without one; among rows
    with that id, the one with the smallest hash of id and text).  Of repeated rows one stays.
    With ``similar`` texts are linked as well when the sets of their ``similar_shingle``-word
    shingles have at least this Jaccard similarity: candidates share a band of least values (see
    ``BANDS``), and every candidate pair is compared exactly unless its texts are in one component
    already.  All texts without a word have equal fingerprints and sets: one of them stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    if similar is None:
        fps = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
        placed = fps.join(_classes(fps, scratch, node_rows), "fp")
    else:
        rows = scratch.keep(_sketches(docs, id_col, text_col, shingle, similar_shingle))
        columns = {"id_col": id_col, "text_col": text_col, "shingle": similar_shingle}
        placed = _row_classes(docs, rows, scratch, similar, node_rows, **columns)
    winners = (
        placed.groupBy("component")
        .agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first"))
        .select(F.col("first.row").alias("__row"))
    )
    kept = docs.withColumn("__row", row_key(id_col, text_col)).join(
        scratch.keep(winners), "__row", "left_semi"
    )
    spot = Window.partitionBy("__row").orderBy("__row")
    return (
        kept.withColumn("__spot", F.row_number().over(spot))
        .filter(F.col("__spot") == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
