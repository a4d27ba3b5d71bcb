"""Source divergence audit: how far the word use of each source lies from the others and from its language.

Identical texts of a language are collapsed first.  Every task keeps the text of the first copy it meets
and only counts the later ones, by source; copies then meet at the digest of their text, so a text is
cut into terms once, however many rows and sources hold it.  Its terms are added with the number of its
rows (document frequency) and with its rows by source (counts).  Kept terms are those of enough
documents of the language.  The divergence of two sources is summed over the terms that either uses:
terms that neither uses differ by a constant, terms that one uses follow from a histogram of its
shares, and only terms that both use are looked at pair by pair.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitkit.llm.common import Scratch

#: Documents of a language that must hold a kept term; what is added to every count; ranks of the term part.
LEAST_DOCUMENTS = 30
SMOOTH = 5
TOP_TERMS = 50
#: Entries that a task holds while it collapses texts or counts terms, and pair products at once.
HELD_TEXTS = 200_000
HELD_TERMS = 500_000
PAIR_CELLS = 1 << 20

#: Letters a-z, A-Z in lower case, and every byte of a character beyond ASCII; all else separates.
_TERM = bytes(
    c if c >= 128 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)
) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TERM).split()


def _batch(names: list[str], columns: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names)


COPIES = "lang string, digest binary, source string, n long, text binary"
_COPY_NAMES = ["lang", "digest", "source", "n", "text"]
_COPY_KINDS = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with its text for the first copy a task meets, counts by source for the later ones."""
    more: Counter = Counter()
    seen: set = set()

    def flush():
        keys = list(more)
        yield _batch(
            _COPY_NAMES,
            [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], list(more.values()), [None] * len(keys)],
            _COPY_KINDS,
        )
        more.clear()
        seen.clear()

    for batch in batches:
        first = [[] for _ in _COPY_NAMES]
        held = 0
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            digest = hashlib.sha256(text).digest()
            if (lang, digest) in seen:
                more[lang, digest, source] += 1
                continue
            seen.add((lang, digest))
            for column, value in zip(first, (lang, digest, source, 1, text)):
                column.append(value)
            held += len(text)
            if held > 16 << 20:
                yield _batch(_COPY_NAMES, first, _COPY_KINDS)
                first, held = [[] for _ in _COPY_NAMES], 0
        if first[0]:
            yield _batch(_COPY_NAMES, first, _COPY_KINDS)
        if len(seen) + len(more) > HELD_TEXTS:
            yield from flush()
    yield from flush()


COUNTS = "lang string, source string, term binary, docs long, n long"
_COUNT_NAMES = ["lang", "source", "term", "docs", "n"]
_COUNT_KINDS = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by language and digest, the text first; counts leave added up by task.

    ``docs`` holds the document frequency on rows of one of the sources only; it is summed over all.
    """
    docs: dict = {}
    uses: dict = {}
    size = 0

    def flush():
        for (lang, source), count in uses.items():
            names, own = list(count), docs.pop((lang, source), {})
            for at in range(0, len(names), 100_000):
                part = names[at : at + 100_000]
                yield _batch(
                    _COUNT_NAMES,
                    [[lang] * len(part), [source] * len(part), part, [own.get(t, 0) for t in part], [count[t] for t in part]],
                    _COUNT_KINDS,
                )
        uses.clear()
        docs.clear()

    def add(lang: str, by_source: Counter, text: bytes) -> int:
        terms = terms_of(text)
        if not terms:
            return 0
        main = min(by_source)
        here = docs.setdefault((lang, main), Counter())
        rows = sum(by_source.values())
        if rows == 1:
            here.update(set(terms))
            uses.setdefault((lang, main), Counter()).update(terms)
            return len(terms)
        once = Counter(terms)
        for t in once:
            here[t] += rows
        for source, n in by_source.items():
            use = uses.setdefault((lang, source), Counter())
            for t, k in once.items():
                use[t] += k * n
        return len(once) * len(by_source)

    key, by_source, text = None, Counter(), b""
    for batch in batches:
        lang, digest, source, n, body = (batch.column(i) for i in range(5))
        for i, found in enumerate(zip(lang.to_pylist(), digest.to_pylist())):
            if found != key:
                if key is not None:
                    size += add(key[0], by_source, text)
                key, by_source, text = found, Counter(), None
            if text is None and body[i].is_valid:
                text = body[i].as_py()
            by_source[source[i].as_py()] += n[i].as_py()
            if size > HELD_TERMS:
                held = sum(map(len, uses.values()))
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
                size = held
    if key is not None:
        add(key[0], by_source, text)
    yield from flush()


def share(count: Column, total: Column) -> Column:
    """``1 + floor(10**9 * count / total)`` in whole numbers.

    Three digits at a time, so that nothing leaves 64 bits while ``total`` is below 9 * 10**15.
    """
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * F.lit(1000).cast("long")
        out = out * F.lit(1000).cast("long") + F.call_function("div", scaled, total)
        rest = scaled % total
    return out + 1


def term_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, source, n``: occurrences of the kept terms by source, where there are any."""
    copies = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_collapse, COPIES)
    # Texts go before counts of later copies; empty text is no null.
    dealt = copies.repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    counts = dealt.mapInArrow(_count_terms, COUNTS).repartition("lang", "term")
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = Window.partitionBy("lang", "term")
    kept = by_source.withColumn("docs", F.sum("docs").over(whole)).filter(F.col("docs") >= least)
    return scratch.keep(kept.select("lang", F.col("term").cast("string").alias("term"), "source", "n"))


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of two sources add to the sum of their pair, added up by task.

    Rows come sorted by language and term.  Terms of as many sources are looked at together, in
    pieces of at most ``PAIR_CELLS`` pairs; sums leave whenever that many pairs are held.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    names = ["lang", "source", "item", "more"]
    ids: dict = {}
    labels: list = []
    sums: dict = {}
    held: list[np.ndarray] = []

    def flush():
        if not sums:
            return
        a, b = zip(*sums)
        yield _batch(
            names,
            [[labels[i][0] for i in a], [labels[i][1] for i in a], [labels[j][1] for j in b], list(sums.values())],
            kinds,
        )
        sums.clear()

    def work(rows: np.ndarray):
        """rows: term number, source, p, p of an unused term."""
        start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        width = np.diff(np.r_[start, rows.shape[1]])
        for k in np.unique(width):
            if k < 2:
                continue
            at = start[width == k]
            high = max(1, PAIR_CELLS // int(k * k))
            wide = max(1, PAIR_CELLS // int(k))
            for i in range(0, len(at), high):
                cells = at[i : i + high, None] + np.arange(k)
                s, p, z = (rows[r][cells] for r in (1, 2, 3))
                for j in range(0, k, wide):
                    part = slice(j, j + wide)
                    one, two = (slice(None), part, None), (slice(None), None, slice(None))
                    value = (
                        np.abs(p[one] - p[two]) - np.abs(p[one] - z[two]) - np.abs(z[one] - p[two]) + np.abs(z[one] - z[two])
                    )
                    pair = s[one] * len(labels) + s[two]
                    keys, spot = np.unique(pair, return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, spot.ravel(), value.ravel())
                    for key, x in zip(keys.tolist(), total.tolist()):
                        a, b = divmod(key, len(labels))
                        if a != b:
                            sums[a, b] = sums.get((a, b), 0) + x
                    if len(sums) > PAIR_CELLS:
                        yield from flush()

    count, last = 0, None
    for batch in batches:
        lang, term, source, p, z = (batch.column(i).to_pylist() for i in range(5))
        rows = np.empty((4, len(lang)), np.int64)
        for i, (a, t, s) in enumerate(zip(lang, term, source)):
            if (a, t) != last:
                count, last = count + 1, (a, t)
            if (a, s) not in ids:
                ids[a, s] = len(labels)
                labels.append((a, s))
            rows[0, i], rows[1, i] = count, ids[a, s]
        rows[2], rows[3] = p, z
        held.append(rows)
        whole = np.concatenate(held, axis=1)
        cut = int(np.searchsorted(whole[0], count))
        if cut:
            yield from work(whole[:, :cut])
        held = [whole[:, cut:]]
    if held and held[0].shape[1]:
        yield from work(np.concatenate(held, axis=1))
    yield from flush()


def audit_sources(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of sources and the terms that mark them.

    Part ``pair`` has one row for each other source of the language, part ``term`` the ``top`` kept
    terms that the source uses more than its language does.  ``docs`` needs ``text, lang, source``;
    nulls in them count as '', other columns are not read.  Repeated rows count as often as they stand.
    A text without a term still makes its source one of the language; a language without a kept term
    has value 0 for every pair.  Ties rank by item in UTF-8 order.  An empty table gives an empty
    result.  A text of any length is cut into terms whole; texts are taken for identical by SHA-256.
    All numbers are exact below 9 * 10**15 terms in a language.
    """
    scratch = Scratch(docs.sparkSession, "sources")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    occurring = scratch.keep(rows.select("lang", "source").distinct())
    counts = term_counts(rows, scratch, least)

    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    by_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    smooth = F.lit(SMOOTH).cast("long")
    groups = (
        occurring.join(by_lang, "lang", "left")
        .join(by_source, ["lang", "source"], "left")
        .na.fill(0, ["terms", "lang_total", "total", "used"])
        .withColumn("size", F.col("total") + smooth * F.col("terms"))
        .withColumn("lang_size", F.col("lang_total") + smooth * F.col("terms"))
        .withColumn("unused", F.when(F.col("size") > 0, share(smooth, F.col("size"))).otherwise(0))
    )
    groups = scratch.keep(groups.select("lang", "source", "terms", "used", "size", "lang_size", "unused"))
    whole = Window.partitionBy("lang", "term")
    shares = (
        counts.withColumn("lang_n", F.sum("n").over(whole))
        .join(groups, ["lang", "source"])
        .select(
            "lang",
            "term",
            "source",
            share(F.col("n") + smooth, F.col("size")).alias("p"),
            share(F.col("lang_n") + smooth, F.col("lang_size")).alias("q"),
            "unused",
        )
    )
    shares = scratch.keep(shares)

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = (
        shares.filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
    )
    pairs = pair_sums(groups, shares).withColumn("rank", F.row_number().over(ranked))
    return terms.unionByName(pairs)


def pair_sums(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, part, item, value`` for each ordered pair of sources of a language."""
    names = ["lang", "source", "item"]
    other = groups.select("lang", F.col("source").alias("item"), F.col("unused").alias("other"))
    # Terms that neither uses, as if it held for all of them.
    apart = F.abs(F.col("unused") - F.col("other"))
    ordered = groups.join(other, "lang").filter("source <> item")
    neither = ordered.select(*names, (F.col("terms") * apart).alias("more"))
    # Terms of one source against the constant share that the other gives terms it does not use.
    histogram = shares.groupBy("lang", "source", "p", "unused").agg(F.count("*").alias("k"))
    one = (
        histogram.join(other, "lang")
        .filter("source <> item")
        .groupBy(*names)
        .agg(F.sum(F.col("k") * (F.abs(F.col("p") - F.col("other")) - apart)).alias("more"))
    )
    turned = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "more")
    both = (
        shares.select("lang", "term", "source", "p", "unused")
        .repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(_both, "lang string, source string, item string, more long")
    )
    return (
        neither.unionByName(one)
        .unionByName(turned)
        .unionByName(both)
        .groupBy(*names)
        .agg(F.sum("more").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
