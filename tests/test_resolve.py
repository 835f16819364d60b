import itertools
import random

import pytest
from pyspark.sql import Observation

from pricelattice.functions.similarity import ratio_of, token_set_of, token_sort_of
from pricelattice.operators.resolve import catalog_hits, duplicate_products, match_barcode, match_catalog, match_sku, similar_names


def test_hand_values():
    assert ratio_of("abc", "abc") == 100 and ratio_of("abcd", "abxd") == 75 and ratio_of("", "") == 100
    assert token_sort_of("тъмна бира", "бира тъмна") == 100
    assert token_set_of("бира тъмна", "бира") == 100 and token_set_of("", "x") == 0


def test_blocked_join_is_brute_force(spark):
    names = ["red apple", "apple red", "red apples", "green apple", "milk 3 percent", "milk 3 percents", "мляко прясно", "прясно мляко 2", "x", "y"]
    got = {(r.a, r.b) for r in similar_names(spark.createDataFrame([(n,) for n in names + names], "name string")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(set(names)), 2) if token_sort_of(a, b) >= 80}


def some_names(kind):
    rng = random.Random(3)
    words = ["red", "green", "apple", "milk", "мляко", "прясно", "хляб", "3", "percent", "of", "a", "bio"]
    if kind == "skewed":  # nearly all begin alike
        return [f"pack of sweet cookies {k:03d}" for k in range(150)] + ["pack of sweet biscuits", "a", "ab", "abc"]
    if kind == "short":
        return ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(250)]
    if kind == "spread":
        return ["".join(rng.choice("etaoinshrdlucmfw ") for _ in range(rng.randrange(6, 30))) for _ in range(1200)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    return base + ["".join(c for c in n if rng.random() > 0.08) for n in base]


@pytest.mark.parametrize("kind, least", [("words", 80), ("skewed", 80), ("short", 80), ("spread", 80), ("words", 90), ("words", 60)])
def test_no_pair_is_lost(spark, kind, least):
    seen = Observation()
    names = spark.createDataFrame([(n,) for n in some_names(kind)], "name string")
    got = {(r.a, r.b): r.score for r in similar_names(names, float(least), seen).collect()}
    own = sorted({" ".join(n.split()) for n in some_names(kind)} - {""})
    want = {(a, b): round(token_sort_of(a, b), 4) for a, b in itertools.combinations(own, 2) if token_sort_of(a, b) >= least}
    assert got == want
    if kind == "spread":
        assert seen.get["candidates"] < len(own) * (len(own) - 1) / 2 / 4


def test_catalog_is_brute_force(spark):
    names = sorted(set(some_names("words")))[:120]
    catalog = spark.createDataFrame(list(enumerate(names)), "ordinal long, name string")
    titles = [" ".join(n.split()) for n in some_names("words")[150:260]] + ["zzz", "qq 77", "apple"]
    got = {}
    for size in (1000, 50):  # one pass, three passes
        rows = match_catalog(spark.createDataFrame([(n,) for n in titles], "title string"), catalog, slice_size=size).collect()
        got[size] = {(r.title, r.place): (r.catalog_name, r.score) for r in rows}
    norm = [" ".join(n.split()) for n in names]
    for title in {x for x in titles if x}:
        best = sorted(range(len(names)), key=lambda k: (-token_set_of(title, norm[k]), k))[:5]
        for place, k in enumerate(best, 1):
            assert got[1000][title, place] == got[50][title, place] == (names[k], round(token_set_of(title, norm[k]), 4))
    first = [r.n_scored for r in match_catalog(spark.createDataFrame([(n,) for n in titles], "title string"), catalog).where("place = 1").collect()]
    assert sum(first) < 0.7 * len(first) * len(names)


def test_catalog_decisions(spark):
    c = spark.createDataFrame([(1, "Бира", "Бира"), (2, "Бира тъмна", "Бира"), (3, "Сок", "Сокове")], "ordinal int, name string, category string")
    t = spark.createDataFrame([("бира тъмна",), ("Нещо друго тук",), ("съвсем чуждо",), ("  ",), (None,)], "title string")
    d = spark.createDataFrame(
        [("Нещо друго тук", "Сок", "A", None, "x"), ("Нещо друго тук", "Хляб", "B", None, None), ("съвсем чуждо", "Хляб", None, None, None), ("бира тъмна", "Сок", None, None, None)],
        "raw_title string, catalog_match string, brand string, pack_info string, additional_info string",
    )
    got = {r.title: (r.catalog_name, r.category, r.found_by, r.decided_brand) for r in catalog_hits(t, c, d).collect()}
    assert got == {"бира тъмна": ("Бира", "Бира", "score", None), "Нещо друго тук": ("Сок", "Сокове", "decision", "A"), "съвсем чуждо": (None, None, None, None)}
    assert {r.found_by for r in catalog_hits(t, c).collect()} == {"score", None}


def test_sku(spark):
    cols = "id int, name string, brand string, pack_info string"
    p = spark.createDataFrame([(1, "Mleko", "A", "1 l"), (2, "Mleko 3", "A", "2 l"), (3, "Sir", None, None)], cols).withColumnRenamed("id", "product_id")
    i = spark.createDataFrame([(1, "mleko!", " a ", "1 L"), (2, "other", "A", "2 l"), (3, "sir", None, None), (4, "none", "Z", "1 l")], cols)
    got = {r.item_no: (r.product_id, r.matched_by) for r in match_sku(i.withColumnRenamed("id", "item_no"), p).collect()}
    assert got == {1: (1, "name"), 2: (2, "brand and pack"), 3: (3, "name"), 4: (None, None)}


def test_catalog(spark):
    c = spark.createDataFrame([(1, "Бира"), (2, "Бира (тъмна)"), (3, "Сок")], "ordinal int, name string")
    t = spark.createDataFrame([("бира тъмна",), ("нещо друго тук",)], "title string")
    best = {r.title: (r.catalog_name, r.matched) for r in match_catalog(t, c).where("place = 1").collect()}
    assert best["бира тъмна"] == ("Бира", True) and best["нещо друго тук"][1] is False


def test_sku_takes_every_row(spark):
    """The registered query against brute force over all products."""
    from pricelattice.fixtures import load
    from pricelattice.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    p = [(r.product_id, r.name, r.brand, r.pack_info) for r in load(spark, sf, "products").orderBy("product_id").collect()]
    got = {r.item_no: (r.product_id, r.matched_by) for r in QUERIES["match_sku"](spark, sf).collect()}
    assert got == brute_sku([(i, n + "s", b, k) for i, n, b, k in p], p)


def brute_sku(items, products):
    out = {}
    for i, name, brand, pack in items:
        fits = [(q, n) for q, n, b, k in products if b == brand and (pack is None or k == pack)]
        named = min(((-ratio_of(name, n), q) for q, n in fits if ratio_of(name, n) >= 90), default=None)
        back = fits and brand is not None and pack is not None and any(c.isdigit() for c in pack)
        out[i] = (named[1], "name") if named else (min(q for q, _ in fits), "brand and pack") if back else (None, None)
    return out


def test_sku_is_brute_force(spark):
    names = ["", "red apple", "red apples", "red appel", "green apple", "milk 3 percent", "milk 3 percents", "мляко прясно", "x"]
    sides = [
        [(k, n, b, c) for k, (n, b, c) in enumerate(itertools.product(names[z::2] + names[:3], [None, "a", "b"], [None, "1 l", "2 l", "l"]))][z :: 3 - z]
        for z in (0, 1)
    ]
    cols = "id int, name string, brand string, pack_info string"
    i, p = (spark.createDataFrame(x, cols) for x in sides)
    rows = match_sku(i.withColumnRenamed("id", "item_no"), p.withColumnRenamed("id", "product_id")).collect()
    assert len(rows) == len(sides[0])
    assert {r.item_no: (r.product_id, r.matched_by) for r in rows} == brute_sku(*sides)


def test_an_item_without_a_pack_takes_a_product_without_one(spark):
    """Of equally good names; a better name comes first, and a product of any pack is better than none."""
    cols = "product_id int, name string, brand string, pack_info string"
    p = spark.createDataFrame([(1, "cold bolt", "A", "6 x 2 l"), (2, "cold bolt", "A", None), (3, "red anvil", "A", "1 l"), (4, "red anvill", "A", None)], cols)
    i = spark.createDataFrame([(1, "cold bolts", "A", None), (2, "red anvil", "A", None), (3, "cold bolts", "A", "6 x 2 l")], cols.replace("product_id", "item_no"))
    assert {r.item_no: r.product_id for r in match_sku(i, p).collect()} == {1: 1, 2: 3, 3: 1}
    assert {r.item_no: r.product_id for r in match_sku(i, p, own_pack_first=True).collect()} == {1: 2, 2: 3, 3: 1}


def test_duplicates_count_equal_names(spark):
    names = ["Milk 1 l", "milk 1 l", "l milk, 1", "чай", "чаи", "butter", None, ""]
    got = {r.product_id: (r.name, r.n_links) for r in duplicate_products(spark.createDataFrame(list(enumerate(names)), "product_id int, name string")).collect()}
    assert got == {0: ("milk 1 l", 2), 1: ("milk 1 l", 2), 2: ("l milk 1", 2), 3: ("чаи", 1), 4: ("чаи", 1), 5: ("butter", 0), 6: (None, 0), 7: ("", 0)}


def test_barcode(spark):
    p = spark.createDataFrame([(5, "123"), (3, " 123 "), (1, ""), (2, None)], "product_id int, barcode string")
    i = spark.createDataFrame([(1, "123"), (2, ""), (3, None), (4, "9")], "item_no int, barcode string")
    assert {r.item_no: r.product_id for r in match_barcode(i, p).collect()} == {1: 3, 2: None, 3: None, 4: None}
