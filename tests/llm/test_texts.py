import re
import numpy as np
import pytest

import corpus_pipeline
from fitkit.llm import licenses, pii, token_shards
from fitkit.llm import piece_lattice as lattice
from fitkit.llm.queries import model_file
from tests.llm.helpers import awkward, empty, prose


@pytest.mark.parametrize("n", [2, 3, 10, 1000])
def test_permutation_is_keyed_and_without_fixed_points(n):
    p = pii.Permutation(b"k", "t", n)
    out = [p.hide(x) for x in range(n)]
    assert sorted(out) == list(range(n))
    assert all(x != y and p.reveal(y) == x for x, y in enumerate(out))
    if n == 1000:
        assert out != [pii.Permutation(b"other", "t", n).hide(x) for x in range(n)]


def test_pseudonyms_keep_formats_and_links():
    text = (
        "a.b9@x.org +1 (017) 555-7713 4845168114407329 or 4845 1681 1440 7329 from 97.51.17.173 "
        "ssn 123-45-6789 on 2020-02-29, 31/12/1999, 1555-01-01 to GB82 WEST 1234 5698 7654 32"
    )
    new, spans = pii.replace_all(text)
    kinds = [k for k, _, _ in spans]
    assert kinds == ["email", "phone", "card", "card", "ip", "ssn", "date", "date", "date", "iban"]
    assert len(new) == len(text)
    parts = {(k, i): new[a:b] for i, (k, a, b) in enumerate(spans)}
    for (k, i), value in parts.items():
        assert value != text[spans[i][1] : spans[i][2]]
    assert parts["card", 2] == parts["card", 3].replace(" ", "")
    digits = parts["card", 2]
    assert pii.luhn_digit(digits[:-1]) == digits[-1]
    assert pii.replace_all(new)[1] == spans
    assert pii.replace_all(new, back=True)[0] == text
    assert pii.replace_all("x " + text)[0] == "x " + new
    assert pii.replace_all(text, key=b"other")[0] != new


def test_an_iban_before_a_short_word_goes():
    for iban in ("ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "AT611904300234573201", "BE68 5390 0754 7034"):
        for tail in (" EUR", " BIC", " 12", " PAID NOW1", " " + iban, ""):
            for head in ("", "AB12 ABCD EFGH "):
                text = f"to {head}{iban}{tail} today"
                new, spans = pii.replace_all(text)
                assert iban not in new and new.replace(new[spans[0][1] : spans[0][2]], iban) == text
                assert pii.replace_all(new)[1] == spans
                assert pii.replace_all(new, back=True)[0] == text


@pytest.mark.parametrize("kind, value", [
    *(("date", x) for x in ("12/25/2020", "07/31/1984", "25/12/2020", "2020/12/25", "2020-1-5", "1/2/2020", "12/5/2020", "5.12.2020")),
    *(("date", x) for x in ("12/25/20", "1/2/84", "25.12.20", "02/29/2020", "12/25/1850", "2020-12-25")),
    *(("phone", x) for x in ("1-800-555-1234", "555.123.4567", "555 123 4567", "555-123-4567", "(555) 123 4567", "1 555 123 4567")),
])
def test_no_notation_of_a_date_or_phone_stays(kind, value):
    text = f"on {value}, or ({value})."
    new, spans = pii.replace_all(text)
    assert spans == [(kind, 3, 3 + len(value)), (kind, 9 + len(value), 9 + 2 * len(value))] and value not in new
    assert pii.replace_all(new) != (new, []) and pii.replace_all(new)[1] == spans
    assert pii.replace_all(new, back=True)[0] == text


def test_invalid_numbers_stay():
    text = "4845168114407328 999.1.1.1 000-12-3456 2021-02-30 GB82WEST12345698765433 1.2.3.4.5 @x.org"
    assert pii.replace_all(text) == (text, [])


def test_pseudonymised_table(spark):
    extra = [(9, "x" * 200_000 + " a.b@c.org", "en", "s", 1)]
    df = awkward(spark, extra)
    got = pii.pseudonymise(df)
    assert got.count() == 10
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text is None and rows[1].pii == [] and rows[2].text == ""
    assert len(rows[9].pii) == 1 and "a.b@c.org" not in rows[9].text
    back = pii.pseudonymise(got, back=True)
    assert back.select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0
    assert pii.without_pii(empty(spark)).count() == 0


def test_licence_rules(spark):
    bsd = "\n\n".join(licenses.TEXTS[k] for k in ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse"))
    mit = "\n\n".join(licenses.TEXTS[k] for k in ("MIT-grant", "MIT-notice", "MIT-asis")).replace("in the Soft", "in\nthe Soft")
    extra = [
        (30, bsd, "en", "s", 1),
        (31, "Heading\nReleased under the MIT License.\nmore", "en", "s", 1),
        (32, mit + "\n\nLicensed under CC BY-NC 4.0.", "en", "s", 1),
        (33, licenses.TEXTS["BSD-grant"], "en", "s", 1),
        (34, "licensed  UNDER the apache license, version 2.0", "en", "s", 1),
    ]
    got = {r.doc_id: (r.sentences, r.licences) for r in licenses.recognise(awkward(spark, extra)).collect()}
    assert {k: v[1] for k, v in got.items()} == {
        30: ["BSD-3-Clause"],
        31: ["MIT"],
        32: ["MIT", "CC-BY-NC-4.0"],
        33: ["fragment"],
        34: ["Apache-2.0"],
    }
    assert licenses.recognise(empty(spark)).count() == 0


def test_wrapped_references_and_articles(spark):
    rows = [
        (1, "Released under\nGPLv3."),
        (2, "Text. Published under\nCC BY-SA 4.0."),
        (3, "Released under\tGPLv3."),
        (4, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (5, "Licensed under an MIT License."),
        (6, "Found under\nthe table."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licenses.recognise(df).collect()}
    assert got == {1: ["GPL-3.0"], 2: ["CC-BY-SA-4.0"], 3: ["GPL-3.0"], 4: ["CC-BY-4.0"], 5: ["MIT"]}


HEADERS = {
    "MIT": ("MIT-grant", "MIT-notice", "MIT-asis", "MIT-liable"),
    "ISC": ("ISC-grant", "ISC-asis", "ISC-liable"),
    "0BSD": ("0BSD-grant", "ISC-asis", "ISC-liable"),
    "BSD-2-Clause": ("BSD-grant", "BSD-source", "BSD-binary", "BSD-asis", "BSD-liable"),
    "BSD-3-Clause": ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse", "BSD-asis", "BSD-liable"),
    "BSD-4-Clause": ("BSD-grant", "BSD-source", "BSD-binary", "BSD-advert", "BSD-endorse", "BSD-asis"),
    "Apache-2.0": ("Apache-grant", "Apache-copy", "Apache-asis", "Apache-see"),
    "GPL-3.0-or-later": ("GPL-free", "GPL-hope", "GPL-see"),
    "GPL-3.0-only": ("GPL3-only", "GPL-hope", "GPL-see"),
    "GPL-2.0-or-later": ("GPL2-free", "GPL-hope", "GPL-see"),
    "GPL-2.0-only": ("GPL2-only", "GPL-hope", "GPL-see"),
    "LGPL-2.1-or-later": ("LGPL-free", "LGPL-hope", "LGPL-see"),
    "LGPL-3.0-or-later": ("LGPL3-free", "LGPL-hope", "LGPL-see"),
    "AGPL-3.0-or-later": ("AGPL-free", "GPL-hope", "AGPL-see"),
    "MPL-2.0": ("MPL-terms", "MPL-copy"),
    "EPL-2.0": ("EPL2-terms",),
    "Zlib": ("Zlib-asis", "Zlib-liable", "Zlib-grant"),
    "BSL-1.0": ("BSL-grant",),
    "OFL-1.1": ("OFL-terms",),
    "WTFPL": ("WTFPL-do",),
    "CC0-1.0": ("CC0-waive",),
    "Unlicense": ("Unlicense-domain", "Unlicense-anyone"),
}


def test_headers_give_their_licence_alone(spark):
    """As it stands, wrapped as a comment, in capitals, and with another holder."""

    def wrapped(text):
        words, lines, line = text.split(), [], ""
        for w in words:
            if len(line) + len(w) > 60:
                lines.append(line)
                line = ""
            line += " " + w
        return "\n".join(f" *{x}" for x in [*lines, line])

    rows, want = [], {}
    for k, (name, ids) in enumerate(HEADERS.items()):
        whole = [licenses.TEXTS[i] for i in ids]
        ours = [re.sub("(?i)the copyright holders?( and contributors| or contributors)?", "Example Org", t) if "BSD" in i else t for i, t in zip(ids, whole)]
        for j, text in enumerate(("\n\n".join(whole), "\n *\n".join(map(wrapped, whole)).replace("\n *\n", "\n\n"), "\n\n".join(whole).upper(), "\n\n".join(ours))):
            rows.append((10 * k + j, text))
            want[10 * k + j] = name
    got = {r.doc_id: r.licences for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == {i: [n] for i, n in want.items()}


def test_expressions_versions_and_marks(spark):
    cases = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "# spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause": ["GPL-2.0-only", "BSD-3-Clause"],
        "/* SPDX-License-Identifier: LGPL-3.0-or-later */": ["LGPL-3.0-or-later"],
        "Released under.GPLv3.": ["GPL-3.0"],
        "Licensed under the GNU General Public License, version 2 or later.": ["GPL-2.0-or-later"],
        "Distributed under GPLv3 only.": ["GPL-3.0-only"],
        "This project is licensed under the Boost Software License 1.0.": ["BSL-1.0"],
        "The licence of this text is nobody's business.": None,
    }
    rows = list(enumerate(cases))
    got = {r.doc_id: r.licences for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got.get(i) for i, _ in rows] == list(cases.values())


def test_licences_of_the_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    lines = {
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "MIT": "Released under the MIT License.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    }
    want = {(i, k) for i, t in zip(docs.doc_id, docs.text) for k, x in lines.items() if x in t}
    rows = licenses.recognise(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {(r.doc_id, x) for r in rows for x in r.licences} == want


def byte_tokens():
    return lambda text: np.frombuffer(text.encode(), np.uint8).astype("<u2").tobytes()


def test_slots_are_a_permutation():
    for n in (1, 2, 7, 1000, 4097):
        p = token_shards.SlotPermutation(n, key=5)
        slots = p.slot(np.arange(n))
        assert sorted(slots) == list(range(n))
        assert (p.inverse(slots) == np.arange(n)).all()


def test_shards_hold_every_token_once(spark, tmp_path):
    df = awkward(spark)
    options = dict(end_id=300, sequence=64, shard_slots=50, buckets=7, pad_id=301)
    rows = token_shards.materialise(df, byte_tokens, path=str(tmp_path), **options).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    data = token_shards.read_slots(str(tmp_path), 0, len(rows), 64, 50)
    by_index = sorted(rows, key=lambda r: r.seq)
    tokens = np.concatenate([data[r.slot][: r.n_tokens] for r in by_index])
    found = sorted(bytes(x.astype(np.uint8)).decode() for x in np.split(tokens, np.flatnonzero(tokens == 300) + 1)[:-1] for x in [x[:-1]])
    assert found == sorted(r.text for r in df.collect() if r.text is not None)
    # Another layout gives the same slots, and reading may start anywhere.
    again = token_shards.materialise(df.repartition(5), byte_tokens, path=str(tmp_path / "b"), **options).collect()
    assert sorted(again) == sorted(rows)
    part = token_shards.read_slots(str(tmp_path), 45, 20, 64, 50)
    assert (part == data[45:65]).all()
    assert token_shards.materialise(empty(spark), byte_tokens, path=str(tmp_path / "c"), **options).count() == 0


def best_path(unit, pieces):
    """All segmentations of a short unit by recursion: the highest sum."""
    if not unit:
        return 0.0, []
    out = (float("-inf"), [])
    for k in range(1, len(unit) + 1):
        if unit[:k] in pieces.score:
            s, i = pieces.score[unit[:k]]
            rest, ids = best_path(unit[k:], pieces)
            out = max(out, (s + rest, [i, *ids]), key=lambda x: x[0])
    if unit[0] not in pieces.score:
        rest, ids = best_path(unit[1:], pieces)
        out = max(out, (rest - lattice.FALLBACK_COST, [pieces.byte_ids[b] for b in unit[0].encode()] + ids), key=lambda x: x[0])
    return out


def cost(ids, pieces):
    by_id = {i: s for s, i in pieces.score.values()}
    return sum(by_id.get(i, 0.0) for i in ids)


def test_relational_and_local_lattice_agree_with_all_paths(spark):
    pieces = lattice.Pieces.load(model_file())
    units = ["▁the", "▁onesen", "▁thentia", "▁▁▁a", "▁ciónmen", "▁漢字😀", "ß", "▁x%%%", "▁" + "banana"]
    got = {r.unit: r.ids for r in lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), pieces).collect()}
    local = lattice.LocalLattice(pieces)
    for u in units:
        score, ids = best_path(u, pieces)
        assert cost(got[u], pieces) == cost(ids, pieces) and len(got[u]) > 0
        assert local.encode(u) == got[u]


def test_side_by_side_lattice_equals_the_recurrence():
    pieces = lattice.Pieces.load(model_file())
    many, one = lattice.BatchLattice(pieces), lattice.LocalLattice(pieces)
    units = ["▁the", "▁onesen", "▁▁▁a", "▁漢字😀", "ß", "▁", "\n", "▁x%%%", "▁😀😀a", "é" * 20, "▁banana" * 1]
    units += [u for k in range(300) for u in lattice.UNIT.findall(lattice.normalise(prose(6, k) + " Übñ漢\n  x"))]
    got = many.encode([u.replace("▁", " ").encode() for u in units], "<u2")
    assert got == [np.array(one.encode(u), "<u2").tobytes() for u in units]
    assert many.encode([], "<u2") == []


def test_units_are_cut_as_by_the_pattern():
    texts = ["", "a", " a  b ", "\n\n  x\n", "  ", "x \n y", "▁a ▁b", "漢 字\t."]
    spaced = [(" " + t.replace("▁", " ")).encode() if t else b"" for t in texts]
    units, first = lattice.cut_units(spaced)
    want = [[u.replace("▁", " ").encode() for u in lattice.UNIT.findall(lattice.normalise(t))] for t in texts]
    assert [units.to_pylist()[a:b] for a, b in zip(first[:-1], first[1:])] == want


def test_frequent_units_are_bounded(spark):
    counts = spark.range(1, 1001).selectExpr("concat('u', id) AS unit", "id * 20000 AS n")
    assert 80 <= lattice.frequent_units(counts, 100, 48).count() <= 100
    same = counts.selectExpr("unit", "50000 AS n")
    assert lattice.frequent_units(same, 100, 48).count() == 0
    assert lattice.frequent_units(same, 1000, 48).count() == 1000


def test_agreement_with_the_encoder_of_the_model(spark, sf):
    """Running words: the same pieces for four fifths, and no more pieces than the merges give."""
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=model_file()), lattice.Pieces.load(model_file())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()]
    words = [w for t in texts for w in t.split()]
    made = lattice.BatchLattice(pieces).encode([f" {w}".encode() for w in words], "<u2")
    ours = [np.frombuffer(m, "<u2").tolist() for m in made]
    theirs = model.encode(words)
    assert sum(a == b for a, b in zip(ours, theirs)) >= 0.75 * len(words)
    assert sum(map(len, ours)) <= sum(map(len, theirs))


def test_phones_are_linked_over_notations():
    forms = ["555-123-4567", "(555) 123-4567", "555.123.4567", "1 555 123 4567", "1-555-123-4567", "+1 555 123 4567"]
    digits = {re.sub("[^0-9]", "", pii.replace_all(f"call {f} now")[0])[-10:] for f in forms}
    assert len(digits) == 1 and "5551234567" not in digits


def test_key_comes_from_the_session(spark):
    df = spark.createDataFrame([(1, "mail a.person@example.org or 555-123-4567")], "doc_id long, text string")
    open_key = pii.without_pii(df).first().text
    spark.conf.set(pii.KEY_SETTING, "a key of this run")
    try:
        own = pii.without_pii(df).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert own != open_key and own == pii.without_pii(df, b"a key of this run").first().text


def test_codec_round_trip(spark):
    extra = [(40, "  two  spaces \n\n lines\t", "en", "s", 1), (41, "a" * 20_000, "en", "s", 1)]
    df = awkward(spark, extra)
    codec = lattice.Codec.fit(df, model_file())
    packed = codec.encode(df, packed=True, verify=True)
    assert packed.filter("NOT restored").count() == 0
    rows = codec.decode(codec.encode(df)).select("doc_id", "text", "decoded", "ids").collect()
    assert all(r.text == r.decoded for r in rows) and len(rows) == 11
    by = {r.doc_id: r.ids for r in rows}
    assert by[1] is None and by[2] == []
    assert lattice.Codec.fit(empty(spark), model_file()).encode(empty(spark)).count() == 0


def test_pipeline_equals_its_parts(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    rows = got.toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "pii", "sentencepiece"]
    assert rows.restored.all() and rows.doc_id.is_unique
    for _, stage in corpus_pipeline.STAGES[:4]:
        small = docs.filter("doc_id < 60")
        assert stage(spark, small, sf).columns == docs.columns
    lost = docs.count() - len(rows)
    assert 0 < lost < 0.35 * docs.count()
    assert set(rows.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows.n_tokens.equals(rows.ids.map(len) // 2)
