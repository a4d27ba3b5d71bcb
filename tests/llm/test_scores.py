"""Line quality, source divergence and lexical search."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from fitkit.llm import lexical_search, line_quality, source_audit
from fitkit.llm.queries import op11_quality_classifier
from tests.compare import connect, mismatch
from tests.llm.helpers import COLUMNS, awkward, empty, prose


# --- lines ---------------------------------------------------------------------------------


def test_recursions_equal_all_labellings():
    draw = np.random.default_rng(0)
    counts = np.array([3, 0, 1, 5, 2])
    chains, u, bad, good = line_quality.Chains(counts), draw.normal(size=11), 0.3, -0.7
    got, (_, norm) = line_quality.marginals(chains, u, bad, good), chains.forward(u, bad, good)
    at = 0
    for i, n in enumerate(counts.tolist()):
        own, total, held = u[at : at + n], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            stay = sum((good if b else bad) for a, b in zip(y, y[1:]) if a == b)
            weight = np.exp(own @ np.array(y, float) + stay) if n else 1.0
            total, held = total + weight, held + weight * np.array(y, float)
        if n:
            assert np.isclose(np.log(total), norm[i])
            assert np.allclose(held / total, got[at : at + n])
        at += n


def test_gradient_of_the_document_likelihood():
    draw = np.random.default_rng(1)
    counts, labels = np.array([3, 1, 5, 2]), np.array([1, 0, 0, 1])
    x, theta, chains = draw.normal(size=(11, 4)), draw.normal(size=6), line_quality.Chains(counts)
    slope = line_quality._objective(theta, x, chains, labels)[1]
    for k, e in enumerate(np.eye(6) * 1e-6):
        up, down = (line_quality._objective(theta + s * e, x, chains, labels)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - slope[k]) < 1e-6


def test_measures_of_short_and_long_lines_agree(monkeypatch):
    text = (prose(300, 1) + "\n" + "a b a b a b\n\n \n" + prose(20, 2)).encode()
    whole = line_quality.measure([text, None, b"", b" \n\t"])
    monkeypatch.setattr(line_quality, "CHUNK", 16)
    assert whole[2].tolist() == [3, 0, 0, 0]
    assert np.allclose(line_quality.measure([text, None, b"", b" \n\t"])[0], whole[0])


def test_quality_on_held_out_labels(spark, sf):
    scored = op11_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert scored.count() == 1000 and len(rows) > 80
    right = rows.predicted == rows.quality
    assert right[rows.quality == 0].mean() >= 0.9 and right[rows.quality == 1].mean() >= 0.98


def test_quality_on_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    plain = line_quality.fit_quality(docs, labels.limit(0))
    rows = line_quality.score_quality(docs, plain)
    assert {r.score for r in rows.collect()} == {0.5} and rows.count() == docs.count()
    model = line_quality.fit_quality(docs, labels)
    got = line_quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {len(r.lines) for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert [len(r.lines) for r in got if r.doc_id == 4] == [2]
    assert line_quality.score_quality(empty(spark), model).count() == 0
    one = line_quality.fit_quality(docs, labels.withColumn("quality", line_quality.F.lit(1)))
    assert line_quality.score_quality(docs, one).filter("predicted = 1").count() == docs.count()


# --- sources -------------------------------------------------------------------------------


def test_sources_equal_sql(spark, sf):
    name = "op12_source_audit"
    assert mismatch(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None


def brute_audit(rows, least, top):
    found, pattern = {}, re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [((r[0] or "").translate(small), r[1] or "", r[2] or "") for r in rows]
    for lang in {d[1] for d in docs}:
        mine = [(pattern.findall(t), s) for t, l, s in docs if l == lang]
        df = Counter(t for terms, _ in mine for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter() for _, s in mine}
        for terms, s in mine:
            counts[s].update(t for t in terms if df[t] >= least)

        def shares(c):
            n = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // n for t in kept}

        q, p = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                for k, (value, item) in enumerate(ranked):
                    found[lang, s, part, item] = (value, k + 1)
    return found


def test_sources_with_copies_nulls_and_ties(spark):
    many = prose(60, 4)
    rows = [(prose(12, k % 25), ("en", "de", None)[k % 3], f"s{k % 7}") for k in range(300)]
    rows += [(many, "en", "hot")] * 400 + [(many, "en", f"s{k % 7}") for k in range(40)]
    rows += [(None, "en", "blank"), ("", "xx", None), ("1 2 3", "xx", "é"), ("Ünï ΑΒ ünï", None, None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    docs = docs.withColumn("n", source_audit.F.lit("clash")).withColumn("p", source_audit.F.lit(0))
    got = {
        (r.lang, r.source, r.part, r["item"]): (r.value, r["rank"])
        for r in source_audit.audit_sources(docs, least=6, top=5).collect()
    }
    assert got == brute_audit(rows, 6, 5)
    assert source_audit.audit_sources(empty(spark)).count() == 0
    assert source_audit.audit_sources(awkward(spark)).filter("part = 'term'").count() == 0


def test_sources_when_tasks_hold_little(spark, monkeypatch):
    rows = [(prose(30, k % 40), "en", f"s{k % 4}") for k in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    for name, value in (("HELD_TEXTS", 5), ("HELD_TERMS", 20), ("PAIR_CELLS", 4)):
        monkeypatch.setattr(source_audit, name, value)
    got = {
        (r.lang, r.source, r.part, r["item"]): (r.value, r["rank"])
        for r in source_audit.audit_sources(docs, least=6, top=5).collect()
    }
    assert got == brute_audit(rows, 6, 5)


# --- search --------------------------------------------------------------------------------


def test_search_equals_sql(spark, sf):
    name = "op13_lexical_search"
    assert mismatch(entry.queries()[name](spark, sf), connect(sf), entry.oracle_sql()[name]) is None


def brute_search(docs, items, top):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    bags = [(i, Counter(pattern.findall((t or "").translate(small)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                lexical_search.weight(n_docs, df[t]) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t in set(pattern.findall((text or "").translate(small)))
                if b[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0))
        for k, (score, none, i) in enumerate(sorted(found)[:top]):
            out.append((item, k + 1, None if none else i, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 50])
def test_search_with_copies_ties_and_long_items(spark, block_bytes):
    docs = [(k, prose(5 + k % 60, k % 35)) for k in range(400)] + [(7, prose(12, 7)), (None, prose(9, 3)), (401, None), (402, ".,")]
    docs += [(1000 + k, "same words in every copy") for k in range(300)]
    items = [(1, prose(8, 3)), (1, prose(8, 3)), (2, "same COPY every"), (None, "same"), (3, None), (4, " "), (5, "unheard of")]
    items.append((6, " ".join(f"w{k}" for k in range(90)) + " " + prose(200, 5)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    table = table.withColumn("score", lexical_search.F.lit("clash")).withColumn("n", lexical_search.F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(table, asked, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 10)
    assert lexical_search.search(table, asked.limit(0)).count() == 0
    assert lexical_search.search(empty(spark), asked).count() == 0
    assert lexical_search.search(awkward(spark), asked).count() >= 0


def test_search_leaves_groups_below_the_bar(spark):
    """Most documents share only common words with an item: their groups are never evaluated."""
    import pyarrow as pa

    rows = [(k, [0, 1] if k % 97 else [0, 1, 2, 3]) for k in range(5000)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _ in rows], pa.int64()),
            pa.array([10] * len(rows), pa.int64()),
            pa.array([t for _, t in rows], pa.list_(pa.int32())),
            pa.array([[1] * len(t) for _, t in rows], pa.list_(pa.int64())),
        ],
        ["doc_id", "n", "terms", "tf"],
    )
    best = lexical_search.Best(10)
    piece = lexical_search.Piece(batch, np.array([100, 90, 6000, 5000]), 5000, 50_000)
    assert piece.search(np.arange(4), best) == 52
    assert best.rows[2].tolist() == [97 * k for k in range(10)]


def test_length_factor_beyond_64_bits():
    n = np.array([3, 10**7], np.int64)
    assert lexical_search.length_factor(n, 10**12, 10**16).tolist() == [10, 10 + 90 * 1000]


def test_clashing_columns_do_not_matter(spark):
    docs = awkward(spark)
    assert docs.columns[:5] == [c.split()[0] for c in COLUMNS.split(", ")]
    assert op_rows(source_audit.audit_sources(docs, least=1)) > 0


def op_rows(df):
    return df.count()
