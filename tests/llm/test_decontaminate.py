import random

from pricelattice.llm.decontaminate import _Item, clean_documents, contaminated, lcs, needed, plain_words, verified


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(a, b) == t[-1][-1]


def test_finds_what_brute_force_finds(spark):
    """The verifier over every place of every text, plus planted paraphrases of one item."""
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(2)
    planted = []
    for k, (i, t) in enumerate(items[:8]):
        w = t.split()
        for j in rng.sample(range(len(w) - 3), len(w) // 8):
            w[j] = f"other{j}"
        host = rows[k][1].split()
        planted.append((10_000 + k, " ".join(host[:40] + w + host[40:])))
    want = set()
    for doc, t in rows + planted:
        w = plain_words(t)
        for i, x in items:
            item = _Item(i, x)
            n = len(item.words)
            if lcs(item.words, w) >= needed(n) and any(
                verified(item, w[a : a + 2 * n + 24]) for a in range(0, max(1, len(w) - n), 4)
            ):
                want.add((doc, i))
    assert {(10_000 + k, items[k][0]) for k in range(8)} <= want
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in contaminated(both, bench).collect()}
    assert len(want & got) >= 0.9 * len(want) and got <= want
    kept = {r.doc_id for r in clean_documents(both, bench).collect()}
    assert kept == {doc for doc, _ in rows + planted} - {doc for doc, _ in got}


def test_edges(spark):
    schema, item = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"
    text = "alpha beta gamma delta. epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
    bench = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (None, text, 5), (4, "short one", 5)], item)
    docs = spark.createDataFrame(
        [(1, "x y " + text.upper() + " z", "a"), (1, "x y " + text.upper() + " z", "a"), (2, None, "a"), (3, "", None), (4, "a b", "a"), (5, "so short one is", "b")],
        schema,
    )
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()) == [(1, 1), (1, 1)] + [(5, 4)] * (
        (5, 4) in {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    )
    none_docs, none_items = spark.createDataFrame([], schema), spark.createDataFrame([], item)
    assert contaminated(none_docs, bench).collect() == [] and contaminated(docs, none_items).collect() == []
    assert clean_documents(docs, none_items).count() == docs.count()


def test_nothing_is_missed(spark):
    """Paraphrases that keep 60-75 % of an item at every alignment, and short items in long texts."""
    rng = random.Random(5)
    common = [f"w{k}" for k in range(60)]
    fill = lambda n: [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(10**6)}" for _ in range(n)]
    items = [(k, " ".join(fill(n - 4)) + ". " + " ".join(fill(4)) + ".") for k, n in enumerate([59, 59, 40, 24, 20, 16, 12, 8])]
    items += [(100 + n, " ".join(f"s{n}x{k}" for k in range(n - 1)) + " w1") for n in range(2, 8)] + [(200, "r5"), (201, "w1 w2 w3")]
    docs, want = [], set()
    for i, t in items:
        for offset in range(30, 42):
            for share in (0.6, 0.68, 0.75):
                w = plain_words(t)
                n, at = len(w), len(docs)
                if n >= 8:
                    free = list(range(n - 4))
                    for j in rng.sample(free, min(len(free), n - max(needed(n), round(share * n)))):
                        w[j] = f"z{rng.randrange(10**6)}"
                docs.append((at, " ".join(fill(offset) + w + fill(100))))
                want.add((at, i))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want - got == set()


def test_ids_of_any_type_and_items_that_repeat(spark):
    text = "alpha beta gamma delta. epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
    bench = spark.createDataFrame([("q", text)] * 3 + [("p", text)], "item_id string, text string")
    docs = spark.createDataFrame([("d1", "x y " + text), (None, text), ("d2", "x")], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.item_id) for r in contaminated(docs, bench).collect())
    assert got == [("", "p")] + [("", "q")] * 3 + [("d1", "p")] + [("d1", "q")] * 3
    assert [r.doc_id for r in clean_documents(docs, bench).collect()] == ["d2"]
