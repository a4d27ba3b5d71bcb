"""Queries on the given documents against single-process versions of the same rules."""

import base64
import zlib

import numpy as np

import corpus_pipeline
from fitkit.llm import decontam, langid, pii, simhash, token_shards, toxicity
from fitkit.llm.queries import op5_pii, op10_toxicity
from tests.llm.helpers import prose


def frame(spark, df):
    """A table as Spark would read it again, without its plan."""
    return spark.createDataFrame(df.toPandas(), df.schema)


def test_pipeline_equals_its_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")

    clean = frame(spark, toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).filter("predicted = 0").select(docs.columns))
    single = frame(spark, simhash.keep_first(clean, similar=0.8))
    found = decontam.contaminated(single, bench)
    rest = frame(spark, found.filter("size(found) = 0").select(docs.columns))
    want = {}
    for r in rest.select("doc_id", "text").collect():
        want[r.doc_id] = pii.replace_all(r.text)[0]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(want)
    codec = corpus_pipeline.lattice.Codec.fit(
        spark.createDataFrame(list(want.items()), "doc_id long, text string"), corpus_pipeline.model_file()
    )
    pieces, _ = codec.held.value
    raw = corpus_pipeline.lattice.raw_pieces(pieces)
    for doc_id, text in want.items():
        assert got[doc_id].restored
        ids = np.frombuffer(got[doc_id].ids, codec.width)
        assert corpus_pipeline.lattice.decoded(ids, raw) == text


def test_pseudonyms_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    rows = {r.doc_id: r for r in op5_pii(spark, sf).collect()}
    hit = 0
    for doc_id, text in zip(docs.doc_id, docs.text):
        new, spans = pii.replace_all(text)
        r = rows[doc_id]
        assert r.text == new and r.n_pii == len(spans) and len(new) == len(text)
        hit += bool(spans)
        # No value stays: what stood in a span is gone from it, and the way back gives the text.
        assert all(text[a:b] != new[a:b] for _, a, b in spans)
        assert pii.replace_all(new, back=True)[0] == text
    assert hit >= 40


def test_toxicity_on_held_out_labels(spark, sf):
    got = op10_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    rows = got[got.held_out].merge(labels, on="doc_id")
    assert rows[rows.toxic == 1].predicted.mean() >= 0.5
    assert rows[rows.toxic == 0].predicted.mean() <= 0.02


def test_token_shards_on_given_documents(spark, sf, tmp_path):
    import public_tokenizers as public
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    make = token_shards.byte_bpe(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rows = token_shards.materialise(docs, make, path=str(tmp_path), end_id=50256, pad_id=50256).toPandas()
    assert sorted(rows.slot) == list(range(len(rows)))
    data = token_shards.read_slots(str(tmp_path), 0, len(rows), token_shards.SEQUENCE, token_shards.SHARD_SLOTS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(tuple(plain.encode_ordinary(t)) for t in docs.toPandas().text)
    found = []
    for _, bucket in rows.sort_values("seq").groupby("bucket"):
        tokens = np.concatenate([data[s][:n] for s, n in zip(bucket.slot, bucket.n_tokens)])
        found += [tuple(x[:-1].tolist()) for x in np.split(tokens, np.flatnonzero(tokens == 50256) + 1)[:-1]]
    assert sorted(found) == want


def test_copies_of_a_text_teach_a_language_once(spark):
    hot = prose(60, 1)
    rows = [(k, hot, "aa") for k in range(3000)] + [(5000 + k, prose(60, 10 + k), "aa" if k % 2 else "bb") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    plain = langid._profiles

    def counted(drawn):
        seen.append(drawn.count())
        return plain(drawn)

    langid._profiles = counted
    try:
        langid.fit_languages(docs, 5000)
    finally:
        langid._profiles = plain
    assert seen[0] <= 201


def test_extreme_value_constant_has_no_step(spark):
    """The constant grows from zero with the documents that speak for it."""
    found = []
    for n in (20, 60, 200, 800):
        rows, labels = [], []
        for k in range(n):
            words = prose(40, k).split()
            if k % 3 == 0:
                words[5:9] = ["vile", "vile", "awful", "vile"]
            elif k % 7 == 0:
                words[5] = "vile"
            rows.append((k, " ".join(words)))
            labels.append((k, int(k % 3 == 0)))
        model = toxicity.fit_toxicity(
            spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        )
        found.append(abs(model.log_k))
    assert found[0] <= found[-1] + 1e-9 and all(np.isfinite(found))
