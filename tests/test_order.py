import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricelattice.operators import chains, order, prices, tables
from pricelattice.sources import facts
from pricelattice.sources.shared import folder


def test_groups_are_brute_force(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(40)]
    rng.shuffle(chain)
    loose = [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(170)]
    star = [(500 + k, 999) for k in range(30)] + [(999, 450)]
    links = chain + loose + star + [(7, 7), (None, 3), (3, None), (2, 1), (40, 0)]
    at = {}
    find = lambda x: x if at.setdefault(x, x) == x else find(at[x])
    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            at[b] = a
    want = {(x, find(x)) for x in at if find(x) != x}
    got = order.first_of_group(spark.createDataFrame(links, "a long, b long").repartition(4))
    assert {tuple(r) for r in got.collect()} == want
    assert order.first_of_group(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_takes_the_earliest_and_refusals_win(spark):
    day = lambda d: datetime.date(2024, 1, d)
    p = spark.createDataFrame([(1, "a", "x", day(9)), (2, "b", "x", day(3)), (3, "c", "x", day(3)), (4, "d", "x", None), (5, "e", "x", day(1)), (6, "f", "y", day(1))], "product_id long, name string, brand string, born date")
    r = spark.createDataFrame([(k, 1.0) for k in range(1, 7)], "product_id long, price double")
    d = spark.createDataFrame([(1, 2, True, None), (3, 2, True, "C"), (4, 1, True, "D"), (2, 4, True, None), (5, 1, True, "E"), (1, 5, False, "E"), (6, 6, True, "F"), (6, 77, True, "G")], "id_a long, id_b long, merge boolean, canonical_name string")
    left, moved = chains.merge_duplicates(p, r, d, "born")
    assert sorted(map(tuple, left.select("product_id", "name", "brand").collect())) == [(2, "D", None), (5, "e", "x"), (6, "f", "y")]
    assert sorted(x.product_id for x in moved.collect()) == [2, 2, 2, 2, 5, 6]
    kept, _ = tables.merge_products(p, r, spark.createDataFrame([(1, 1)], "product_id long, kept_id long"))
    assert kept.count() == 6 and kept.where("brand is null").count() == 0


def test_candidates_hold_every_group(spark):
    names = ["Milk 1 l", "milk 1 l", "l milk, 1", "чай", "чаи", "butter", None, "", "milk 1 l"]
    rows = [(k, n, datetime.date(2024, 1, 20 - k)) for k, n in enumerate(names)]
    got = {(r.id_a, r.id_b) for r in chains.merge_candidates(spark.createDataFrame(rows, "product_id long, name string, born date"), "born").collect()}
    assert got == {(8, 0), (8, 1), (2, 8), (4, 3)} or got == {(8, 0), (8, 1), (2, 8), (3, 4)} or {frozenset(x) for x in got} == {frozenset(x) for x in ((8, 0), (8, 1), (2, 8), (3, 4))}


def test_update_takes_the_last_one_whole(spark):
    p = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "product_id long, name string, brand string")
    u = spark.createDataFrame([(1, 1, "x", "z"), (1, 2, "m", None), (3, 1, "q", "q")], "product_id long, at long, name string, brand string")
    assert sorted(map(tuple, tables.update_partial(p, u, ["name", "brand"], order="at").collect())) == [(1, "m", "b"), (2, "c", "d")]
    assert sorted(map(tuple, tables.update_partial(p, u, ["name", "brand"]).collect())) == [(1, "x", "z"), (2, "c", "d")]


def test_halves_go_to_even(spark):
    rows = [(1, 1, Decimal(x), datetime.datetime(2026, 3, 2), 1, k) for k, x in enumerate(("2.34", "2.35"))] + [(1, 2, Decimal(x), datetime.datetime(2026, 3, 2), 2, k) for k, x in enumerate(("2.35", "2.36"))]
    frame = spark.createDataFrame(rows, "product_id long, store_id long, price decimal(12,2), recorded_at timestamp, load_key long, load_line long")
    assert {r.store_id: r.avg_price for r in prices.weekly(frame).collect()} == {1: Decimal("2.34"), 2: Decimal("2.36")}
    two = spark.createDataFrame([(1, s, Decimal(x), datetime.datetime(2026, 3, 2), 1, s) for s, x in ((1, "20.00"), (2, "20.05"), (3, "20.15"))], frame.schema)
    out = prices.compare(two, spark.createDataFrame([(1,), (2,), (3,)], "store_id long"), F.lit(True))
    assert {r.store_id: r.pct_above for r in out.collect()} == {1: Decimal("0.0"), 2: Decimal("0.2"), 3: Decimal("0.8")}


def test_tree(spark):
    rows = [(1, "r", None), (2, "b", 1), (3, "a", 1), (4, "x", 3), (5, "q", None), (6, "a", 1), (7, "loop", 8), (8, "loop", 7), (9, "orphan", 77)]
    tree = order.tree_intervals(spark.createDataFrame(rows, "id long, name string, parent_id long"))
    assert {r.id: (r.depth, r.pre, r.last) for r in tree.collect()} == {5: (0, 0, 0), 1: (0, 1, 5), 3: (1, 2, 3), 4: (2, 3, 3), 6: (1, 4, 4), 2: (1, 5, 5)}
    assert [r.id for r in order.subtree(tree, 1).collect()] == [1, 3, 4, 6, 2]
    assert order.tree_intervals(spark.createDataFrame([], "id long, name string, parent_id long")).count() == 0
    deep = spark.createDataFrame([(k, "n", k - 1 if k else None) for k in range(7)], "id long, name string, parent_id long")
    assert [r.pre for r in order.tree_intervals(deep).orderBy("id").collect()] == list(range(7))
    with pytest.raises(ValueError):
        order.tree_intervals(deep, 3)


def test_series_of_one_hot_key(spark):
    rows = [("hot", k * 7919 % 3000 // 2) for k in range(3000)] + [(None, 5), (None, 4), ("b", 1)]
    got = order.numbered(spark.createDataFrame(rows, "k string, v long").repartition(6), ["k"], ["v"]).collect()
    for k in ("hot", None, "b"):
        own = sorted((r.nth, r.v) for r in got if r.k == k)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted(v for x, v in rows if x == k)


def test_pages(spark):
    names = sorted(f"n{k:04d}" for k in range(500))
    index = order.RankIndex(spark.createDataFrame([(n,) for n in names], "name string").repartition(5), "name", 12)
    assert index.total == 500 and len(index.ranges(200, 20)[0]) <= 2
    for offset, limit in ((0, 20), (199, 100), (490, 50), (500, 10), (9999, 5)):
        rows = index.page(offset, limit).collect()
        assert [r.name for r in rows] == names[offset : offset + limit] and all(r.total == 500 for r in rows)
    assert order.RankIndex(spark.createDataFrame([], "name string"), "name").page(0, 5).count() == 0


def test_batches_are_written_once(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, at(1)), (2, at(2)), (2, at(2)), (3, None)], "k long, recorded_at timestamp")
    path = folder(spark, "facts")
    assert facts.read_facts(spark, path, rows.schema).count() == 0
    facts.write_attempt(rows, path, "b1")  # fails before its manifest
    assert facts.read_facts(spark, path, rows.schema).count() == 0
    assert facts.append_batch(rows, path, "b1") and not facts.append_batch(rows.limit(1), path, "b1")
    assert facts.append_batch(rows.where("false"), path, "empty") and not facts.append_batch(rows, path, "empty")
    assert facts.append_batch(rows.where("k = 1"), path, "2024")
    got = facts.read_facts(spark, path, rows.schema)
    assert sorted((r.k, r.batch, str(r.part)) for r in got.collect()) == [(1, "2024", "2024-01-01"), (1, "b1", "2024-01-01"), (2, "b1", "2024-01-02"), (2, "b1", "2024-01-02"), (3, "b1", "None")]
    assert {(r.batch, r.n) for r in facts.manifests(spark, path).where("n > 0").groupBy("batch").agg(F.sum("n").alias("n")).collect()} == {("b1", 4), ("2024", 1)}
    with pytest.raises(ValueError):
        facts.append_batch(rows, path, "a/b")


def test_whole_ingest(spark):
    at = datetime.datetime(2024, 5, 1)
    cols = "load_key long, load_line long, store_id long, price decimal(12,2), recorded_at timestamp, brand string, name string, pack_info string, barcode string, category string, image_url string, additional_info string"
    item = lambda k, name, brand=None, pack=None, code=None, cat=None, image=None, info=None, store=1: (k, 0, store, Decimal("1.00"), at, brand, name, pack, code, cat, image, info)
    items = spark.createDataFrame(
        [item(1, "Milka", "milka"), item(2, "Нова"), item(3, "Cola", "A", "1 l", "111", "Drinks", "i3"), item(4, "Cola", "A", "1 l", "111"), item(5, "orange juices", "B", "2 l", None, "Juice", "", "fresh"),
         item(6, "Мляко прясно", "C", "1 кг кенче"), item(7, "неясно", None), item(8, "Мляко прясно", "C", "1 кг кенче", store=2), item(9, "Cola", "A", "1 l", "222")], cols,
    )
    products = spark.createDataFrame([(1, "Coca Cola", "A", "1 l", "111", None, ""), (2, "orange juice", "B", "2 l", None, "Old", "img"), (3, "Other", "A", "1 l", "222", None, None)], "product_id long, name string, brand string, pack_info string, barcode string, category string, image_url string")
    prices_ = spark.createDataFrame([(3, 1, "A", at)], "product_id long, store_id long, brand string, recorded_at timestamp")
    catalog = spark.createDataFrame([(1, "Прясно мляко", "Млечни"), (2, "Сирене", "Сирена")], "ordinal long, name string, category string")
    told = spark.createDataFrame([("неясно", "Сирене", "D", "200 г", None)], "raw_title string, catalog_match string, brand string, pack_info string, additional_info string")
    path = folder(spark, "ingest")
    for again in range(2):  # the second run appends nothing
        out, left, counts = chains.ingest_batch(items, products, prices_, catalog, path, "b", told)
        got = {r.load_key: (r.matched_by, r.outcome) for r in out.collect()}
        assert got == {1: (None, "rejected"), 2: (None, "rejected"), 3: ("barcode", "inserted"), 4: ("barcode", "skipped"), 5: ("name", "inserted"), 6: ("new", "inserted"), 7: ("new", "inserted"), 8: ("new", "inserted"), 9: ("barcode", "skipped")}
        assert counts == {"items": 9, "inserted": 5, "skipped": 2, "rejected": 2, "by_barcode": 3, "by_name": 1, "by_new": 3}
        assert facts.read_facts(spark, path, out.schema).count() == 5
    rows = {r.product_id: r for r in left.collect()}
    assert (rows["1"].category, rows["1"].image_url, rows["2"].category, rows["2"].image_url, rows["2"].additional_info) == ("Drinks", "i3", "Old", "img", "fresh")
    new = sorted((r.name, r.brand, r.pack_info, r.status, r.category, r.pack_type) for r in left.collect() if r.status == "pending_review")
    assert new == [("Прясно мляко", "C", "1 кг кенче", "pending_review", "Млечни", "кенче"), ("Сирене", "D", "200 г", "pending_review", "Сирена", None)]


def test_a_shift_is_counted_for_keys_that_go_on_alone(spark):
    """Sizes are counted of the keys that a range begins with: of many small keys the plan broadcasts a row a range at most, and of
    a key over several ranges, null included, no place is lost."""
    from pricelattice.operators import order

    rows = [(None, k) for k in range(700)] + [("a", k) for k in range(700)] + [(f"k{k:03d}", v) for k in range(200) for v in range(2)]
    df = order.numbered(spark.createDataFrame(rows, "k string, v long").repartition(5), ["k"], ["v"])
    got = sorted((r.k or "", r.v, r.nth) for r in df.collect())
    assert got == sorted((k or "", v, v + 1) for k, v in rows)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
