"""Edges of the moderation desk, the log reader, links and search and compare."""

from pyspark.sql import functions as F

from pricelattice.functions import dates
from pricelattice.functions.names import title_case
from pricelattice.operators import chains
from pricelattice.operators import tables as T
from pricelattice.sources import offers


def test_rejections(spark):
    products = spark.createDataFrame([(1, "pending_review"), (2, "active"), (3, None)], "product_id long, status string")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (9, 1), (None, 1), (3, 1)], "product_id long, nth int")
    got = sorted(((r.product_id or 0), r.nth, r.outcome) for r in T.rejections(products, asked, "nth").collect())
    assert got == [
        (0, 1, "not found"), (1, 1, "rejected"), (1, 2, "not found"), (2, 1, "not pending"), (2, 1, "not pending"), (3, 1, "not pending"), (9, 1, "not found"),
    ]
    assert T.rejections(products, asked.limit(0), "nth").collect() == []


def test_log_entries(spark):
    good = ['{"ts":"t","store":"s","level":"ERROR","msg":"m"}', "{}", '{"msg":"\\u00e9 \\"x\\"","z":[1,{"ts":5}]}']
    bad = [None, "", "x", "[]", '"s"', "7", '{"ts":', '{"ts":null}', '{"level":3}', '{"msg":{"a":1}}', '{"store":true}']
    out = offers.log_entries(spark.createDataFrame([(x,) for x in good + bad + good[:1]], "entry string"))
    got = sorted((r.ts, r.store, r.level, r.msg) for r in out.collect())
    assert got == sorted([("t", "s", "ERROR", "m"), ("t", "s", "ERROR", "m"), ("", "", "INFO", ""), ("", "", "INFO", 'é "x"')])


def test_brochure_links(spark):
    at = "https://shop.bg/a/list?x=1#y"
    pages = [
        ('<A class=b HREF="f/1.PDF?v=2">x</a><a href=/f/1.pdf>y</a><a href="/f/1.pdf">y</a>', ["https://shop.bg/a/f/1.PDF?v=2", "https://shop.bg/f/1.pdf"]),
        ('<iframe src="https://view.publitas.com/s/b/?e=1"></iframe><iframe src="/own"></iframe><a href="/brochure/2">x</a>', ["https://view.publitas.com/s/b/"]),
        ('<a href="//issuu.com/d?a=1&amp;b=2">x</a><a href="mailto:a@issuu.com/">m</a><a data-href="/brochure/9">n</a>', ["https://issuu.com/d?a=1&b=2"]),
        ('<script>"<a href=\'/x.pdf\'>"</script><!-- <a href="/y.pdf"> --><a href="' + at + '/">own</a>', []),
        ("<a href=", []), ("", []), (None, []),
    ]
    df = spark.createDataFrame([(p,) for p, _ in pages], "p string").coalesce(1)
    assert [r[0] for r in df.select(dates.brochure_links(F.col("p"), F.lit(at))).collect()] == [want for _, want in pages]
    site = spark.createDataFrame([("/q",), ("q",), ("http://z/q",)], "l string").coalesce(1)
    assert [r[0] for r in site.select(dates.absolute(F.col("l"), F.lit("http://s.bg"))).collect()] == ["http://s.bg/q", "http://s.bg/q", "http://z/q"]


def test_search_compare(spark):
    products = spark.createDataFrame(
        [(1, "Red apple", "B", "active"), (2, "Red pear", None, "active"), (3, "Red plum", "B", "active"), (4, "Red fig", "B", "pending_review")],
        "product_id long, name string, brand string, status string",
    )
    day = "timestamp_ntz'2026-01-0{}'"
    rows = [(1, 1, 3.0, 1, 1), (1, 1, 2.5, 2, 1), (1, 2, 2.0, 1, 2), (2, 1, 1.0, 1, 3), (4, 1, 0.5, 1, 4)]
    prices = spark.createDataFrame(rows, "product_id long, store_id long, price double, d int, load_key int").withColumns(
        {"recorded_at": F.when(F.col("d") == 1, F.expr(day.format(1))).otherwise(F.expr(day.format(2))), "load_line": F.lit(1)}
    )
    stores = spark.createDataFrame([(1, "S1"), (2, "S2")], "store_id long, store_name string")

    def ask(words, most=5):
        return sorted((r.product_id, r.store_name, r.price, r.n_stores) for r in chains.search_compare(products, prices, stores, words, most).collect())

    assert ask("red") == [(1, "S2", 2.0, 2), (2, "S1", 1.0, 1)]  # plum is sold nowhere, fig is not active
    assert ask("ed pea") == [(2, "S1", 1.0, 1)]
    assert ask("red", 1) == [(1, "S2", 2.0, 2)]
    assert ask("nothing") == []


def test_backfills(spark):
    products = spark.createDataFrame(
        [(1, "Milka шоколад", None, None), (2, "Milka шоколад", "own", 7), (3, "Хляб", None, None), (4, "A b", None, None)],
        "product_id long, name string, brand string, category_id long",
    )
    rows = [(1, "x", "K", 1), (3, "y", "K", 1), (3, "z", "L", 2), (3, None, "?", 3), (3, "y", None, 4), (3, "z", None, 5), (2, "x", "L", 1)]
    prices = spark.createDataFrame(rows, "product_id long, brand string, category string, load_key int").withColumns(
        {"recorded_at": F.expr("date_add(date'2026-01-01', load_key)"), "load_line": F.lit(1)}
    )
    categories = spark.createDataFrame([(5, "K"), (4, "K"), (6, "L")], "id long, name string")
    got = sorted((r.product_id, r.name, r.brand) for r in T.backfill_brands(products, prices).collect())
    assert got == [(1, "шоколад", "Milka"), (2, "Milka шоколад", "own"), (3, "Хляб", "y"), (4, "A b", None)]
    found = sorted((r.product_id, r.category_id) for r in T.backfill_category_id(products, prices, categories).collect())
    assert [x or 0 for _, x in found] == [4, 7, 0, 0]  # the latest category of product 3 is unknown
    assert T.backfill_brands(products.limit(0), prices.limit(0)).collect() == []


def test_title_case(spark):
    texts = ["  o'neil  3в1-СИРЕНЕ\t", "", "a", "ÉCOLE d'été 2x", "x_y.z", "12"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1)
    assert [r[0] for r in df.select(title_case(F.col("t"))).collect()] == [*[t.strip().title() for t in texts], None]
