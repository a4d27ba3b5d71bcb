import random
import re

import numpy as np
import pytest
import xxhash

from fitkit.llm import simhash
from fitkit.llm.common import Scratch
from tests.llm.helpers import awkward, empty, prose


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if a < b and (x ^ y).bit_count() <= 3:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("node_rows", [8192, 64])
def test_components_equal_brute_force(spark, node_rows):
    """Balls of near fingerprints, chains and far ones; small nodes force deep cutting."""
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:4]:
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 3]))))
    chain = draw.getrandbits(64)
    for _ in range(25):
        chain ^= sum(1 << b for b in draw.sample(range(64), 3))
        fps.add(chain)
    fps = sorted(fps)
    draw.shuffle(fps)
    rows = [(simhash.signed(f), 10 + i) for i, f in enumerate(fps)]
    scratch = Scratch(spark, "test")
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    edges = simhash.links(distinct, scratch, node_rows)
    roots = {r.id: r.root for r in simhash.connected_components(edges, scratch).collect()}
    want = brute_components([r for _, r in rows], fps)
    assert {r: roots.get(r, r) for _, r in rows} == want


def test_search_in_a_node_equals_all_pairs():
    draw = np.random.default_rng(1)
    centre = draw.integers(0, 1 << 63, dtype=np.uint64)
    fp = {int(centre)}
    while len(fp) < 600:
        flips = draw.choice(64, draw.integers(1, 6), replace=False)
        fp.add(int(centre) ^ sum(1 << int(b) for b in flips))
    fp = np.array(sorted(fp), np.uint64)
    rows = np.stack([np.zeros(len(fp), np.int64)] * 2 + [fp.view(np.int64), np.arange(len(fp))])
    a, b = simhash.near_pairs(rows)
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 3)) if i < j}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_query_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    fps = [plain_fingerprint(t) for t in docs.text]
    want = brute_components(list(docs.doc_id), fps)
    from fitkit.llm.queries import op9_simhash

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in zip(docs.doc_id, fps)}


def test_awkward_rows(spark):
    got = simhash.simhash_components(awkward(spark))
    rows = got.collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {by[i][0].component_id for i in (1, 2, 3)} == {1}
    assert by[1][0].fingerprint == "0" * 16
    assert {r.component_id for r in by[5] + by[6]} == {5}
    assert by[None][0].component_id is None
    kept = simhash.keep_first(awkward(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "7", "None"]
    assert kept.columns == awkward(spark).columns
    assert simhash.simhash_components(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0


def test_near_copies_go(spark):
    base = prose(900, 9).split()
    near = list(base)
    near[450] = "changed"
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, prose(900, 10))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_copies_at_similarity_of_0_8_go_from_the_stage(spark):
    """One of each pair goes exactly when the five-word shingle sets are alike by 0.8."""
    import corpus_pipeline

    def sets(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, gone = [], set()
    for k in range(60):
        base = prose(300, 1000 + k).split()
        near = list(base)
        for at in range(7, 7 + 23 * (k % 12), 23):
            near[at] = f"new{k}x{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        a, b = sets(rows[-2][1]), sets(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            gone.add(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.copies_out(spark, docs, "").collect()}
    assert 20 < len(gone) < 60
    assert kept == {i for i, _ in rows} - gone
    got = corpus_pipeline.copies_out(spark, awkward(spark), "")
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "5", "7", "None"]
    assert corpus_pipeline.copies_out(spark, empty(spark), "").count() == 0


def brute_similar(texts, similar):
    """The smallest index that each text reaches by fingerprints at 3 bits or five-word shingles alike by ``similar``."""
    n = len(texts)
    fps = np.array([simhash.fingerprint_of(t.encode()) for t in texts], np.uint64)
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    names, spot = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((n, len(names)), np.float32)
    held[np.repeat(np.arange(n), [len(x) for x in sets]), spot] = 1
    common = held @ held.T
    size = held.sum(axis=1)
    near = common >= similar * (size[:, None] + size - common)
    near |= np.bitwise_count(fps[:, None] ^ fps) <= 3
    root = np.arange(n)
    while True:
        low = np.where(near, root[None, :], n).min(axis=1)
        if (low == root).all():
            return root, near, np.bitwise_count(fps[:, None] ^ fps) <= 3
        root = low


def test_a_large_group_of_near_copies_and_a_common_line(spark):
    """A thousand loose copies of one text, links of all strengths, and a line that half of the texts share."""
    draw = random.Random(5)
    base = prose(160, 77).split()
    line = prose(60, 78)
    texts = []
    for k in range(1000):
        words = list(base)
        for at in draw.sample(range(160), draw.choice((1, 2, 3, 4, 6, 12))):
            words[at] = f"new{draw.randrange(40)}"
        texts.append(" ".join(words))
    texts += [line + "\n" + prose(draw.randrange(20, 200), 2000 + k) for k in range(600)]
    draw.shuffle(texts)
    root, near, _ = brute_similar(texts, 0.8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    kept = {r.doc_id for r in simhash.keep_first(docs, similar=0.8).collect()}
    want = set(np.flatnonzero(root == np.arange(len(texts))).tolist())
    assert near.sum() > 100_000 and 600 < len(want) < 1500
    # No text goes without a link, and at most one link in a thousand is not a candidate.
    assert want <= kept and len(kept - want) <= 2


def test_candidates_of_a_group_of_copies_grow_with_the_group(spark, monkeypatch):
    """Pairs that are compared: about one for each copy, not one for each pair of copies."""
    seen = []
    plain = simhash.verified

    def counted(pairs, sets, similar):
        seen.append(pairs.count())
        return plain(pairs, sets, similar)

    monkeypatch.setattr(simhash, "verified", counted)
    for n in (150, 300):
        texts = []
        for k in range(n):
            words = prose(400, 3).split()
            for at in range(0, 400, 60):
                words[at] = f"own{k}x{at}"
            texts.append((k, " ".join(words[: 390 + k % 10])))
        seen.clear()
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        monkeypatch.setattr(simhash, "links", lambda distinct, scratch, node_rows: distinct.limit(0).selectExpr("fp a", "fp b"))
        kept = simhash.keep_first(docs, similar=0.7)
        assert kept.count() == 1
        assert sum(seen) <= 3 * n
