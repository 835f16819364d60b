import random

import pytest

from pricelattice.llm import license_scan
from pricelattice.llm.license_scan import LEAST, TEMPLATES, containment, scan
from pricelattice.llm.word_hash import plain_words, word_hashes


def test_word_hashes_name_words():
    texts = ["The cat, the CAT; thé", "", "a_b c-d é", "..."]
    hashes, n = word_hashes(texts)
    words = [plain_words(t) for t in texts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def brute(text):
    """Templates with enough of their shingles within reach of one place."""
    w = plain_words(text)
    out = set()
    for name, t in TEMPLATES.items():
        own = plain_words(t)
        n = len(own)
        if containment(own, w) >= LEAST and any(
            containment(own, w[a : a + 2 * n]) >= LEAST for a in range(0, max(1, len(w) - n + 1), max(1, n // 8))
        ):
            out.add(name)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for k in range(200):
        name = rng.choice(list(TEMPLATES))
        w = TEMPLATES[name].split()
        if len(w) > 40 and k % 2:
            w[rng.randrange(len(w))] = "changed"
        host = rng.choice(rows[:100])[1].split()
        at = rng.randrange(len(host) + 1)
        rows.append((5000 + k, " ".join(host[:at] + w + host[at:])))
    got: dict = {}
    for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    want = {d: b for d, t in rows if (b := brute(t))}
    pairs = lambda x: {(d, n) for d, names in x.items() for n in names}
    assert len(pairs(want) & pairs(got)) >= 0.99 * len(pairs(want))
    assert all(containment(plain_words(TEMPLATES[n]), plain_words(dict(rows)[d])) >= LEAST for d, n in pairs(got))


def test_edges(spark):
    schema = "doc_id long, text string, license string, id int"
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "x. All rights   reserved!", None, None), (3, "x. All rights   reserved!", None, None)]
    rows += [(None, "word " * 70_000 + "released under the MIT license", "x", 1)]
    got = sorted((r.doc_id or 0, r.license, r.containment) for r in scan(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "mit-line", 1.0), (3, "all-rights-reserved", 1.0), (3, "all-rights-reserved", 1.0)]
    assert scan(spark.createDataFrame([], schema)).collect() == []
    assert scan(spark.createDataFrame(rows, schema), {"none": "..."}).collect() == []


def test_templates_of_a_table_and_string_ids(spark, monkeypatch):
    rows = spark.createDataFrame([("own", "one two three four five six seven"), ("own", "eight nine ten eleven twelve"), ("own", None), (None, "x")], "name string, text string")
    texts = license_scan.read_templates(rows.union(rows))
    assert sorted(texts) == ["own", "own#2"]
    docs = spark.createDataFrame([("a", "so one two three four five six seven it is"), (None, "eight nine ten eleven twelve")], "doc_id string, text string")
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs, rows).collect()}
    assert got == {("a", "own#2"), (None, "own")}
    monkeypatch.setattr(license_scan, "MOST_BYTES", 20)
    for templates in (rows, texts):
        with pytest.raises(ValueError):
            license_scan.scan(docs, templates)


def test_whole_licenses_are_found(spark):
    whole = ["mit", "isc", "bsd-2-clause", "zlib"]
    rng = random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    docs = []
    for k, name in enumerate(whole):
        words = license_scan.TEMPLATES[name].split()
        changed = words[:60] + ["other"] + words[61:]
        docs += [(10 * k, f"{filler(300)} {' '.join(words)} {filler(50)}"), (10 * k + 1, f"{filler(7)} {' '.join(changed).lower()}"), (10 * k + 2, filler(400))]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for k, name in enumerate(whole):
        assert {r.doc_id for r in got if r.license == name} == {10 * k, 10 * k + 1}
    assert all(r.containment == 1 for r in got if r.doc_id % 10 == 0 and r.license in whole) and not [r for r in got if r.doc_id % 10 == 2]
