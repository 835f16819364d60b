from pyspark.sql import functions as F

from pricelattice.functions import listing as L
from pricelattice.operators import chains
from pricelattice.sources import catalog
from pricelattice.plans.listing_queries import Q
from pricelattice.sources.offers import listing_prices


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_titles(spark):
    rows = [
        ("Metro Chef Пилешко филе 670 Г", None), ("METRO premium - Сок 6 Х 77 мл ", "x"), ("Хляб", "1 БРОЙ"), ("Хляб", " Кашон "), ("Metro 2КГ", None),
        (" ", ""), (None, None), ("Metro Chef", None),
    ]
    got = values(spark, rows, "t string, p string", L.listing_title(F.col("t"), F.col("p")))
    assert [tuple(x) for x in got[:5]] == [
        ("Пилешко филе", "Metro Chef", "670 г"), ("Сок", "Metro Premium", "6 Х 77 мл"), ("Хляб", None, None), ("Хляб", None, "кашон"), ("2КГ", "Metro", None),
    ]
    assert tuple(got[5]) == ("", None, None) and got[6].name is None and tuple(got[7]) == ("Metro Chef", "Metro Chef", None)


def test_names(spark):
    rows = [("Свинскоfilet",), ("Milk мляко",), ("Мляко Brand",), ("Milk",), ("Мляко",), ("",), (None,)]
    assert values(spark, rows, "n string", L.repaired_name(F.col("n"))) == ["Свинско Филе", "Мляко мляко", None, "Milk", "Мляко", "", None]
    pairs = [("Milka", "milka "), ("Милка", "Milka"), ("Прясно мляко", "Milka"), ("Milka", None), (None, "Milka"), ("", "")]
    assert values(spark, pairs, "n string, b string", L.is_brand_name(F.col("n"), F.col("b"))) == [True, True, False, False, False, False]
    blocks = [("Прясно мляко\n12 34\nВерея 1 л 2,49 лв.",), ("2.49",), ("a\nb\n1.20 €",), (None,)]
    got = values(spark, blocks, "b string", L.brochure_name(F.col("b")))
    assert [(x.name and " ".join(x.name.split()), x.unit) for x in got] == [("Прясно мляко Верея", "1 л"), (None, None), (None, None), (None, None)]
    slugs = [("Crème  brûlée!", "5901234", 1), ("Мляко", None, 1), (None, "12", 1)]
    assert values(spark, slugs, "n string, b string, k long", L.ascii_slug(F.col("n"), F.col("b"), F.col("k"))) == [
        "creme-brulee-1234", "356a192b7913", "356a192b7913-12",
    ]


def test_categories(spark):
    rows = [("Сирене",), ("Нещо",), ("",), (None,)]
    assert values(spark, rows, "c string", L.valid_category(F.col("c"))) == ["Сирене", "Друго", None, None]
    assert values(spark, rows, "c string", L.top_category(F.col("c"))) == ["Млечни продукти", "Друго", None, None]
    assert catalog.taxonomy(spark).count() == 48


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,category\nПрясно мляко,Прясно мляко\n,x\nХляб - бял,\n", encoding="utf-8")
    assert [tuple(r) for r in catalog.read_catalog(spark, str(tmp_path / "c.csv")).collect()] == [
        ("Прясно мляко", "Прясно мляко", "прясно мляко"), ("Хляб - бял", "", "хляб бял"),
    ]
    (tmp_path / "cards.json").write_text(
        '{"name":"Metro Сок 1Л","href":"/p/BTY-X1/0","promo_eur_text":"2,00 €","strike_eur_text":"3,00 €"}\n{"name":"Без цена"}\n', encoding="utf-8"
    )
    got = catalog.listing_offers(catalog.read_cards(spark, str(tmp_path / "cards.json"))).collect()
    assert [(r.name, r.brand, r.pack_info, r.barcode, float(r.price), r.discount_percent) for r in got] == [("Сок", "Metro", "1 л", "BTY-X1", 2.0, 33)]


def test_merge_job(spark):
    products = spark.createDataFrame([(1, "A", "x"), (2, "a", "x"), (3, "A ", "x"), (4, "B", "y")], "product_id long, name string, brand string")
    prices = spark.createDataFrame([(2, 1.0), (4, 2.0)], "product_id long, price double")
    decisions = spark.createDataFrame([(1, 2, True, "Best"), (2, 3, True, None), (1, 4, False, "C")], "id_a long, id_b long, merge boolean, canonical_name string")
    left, moved = chains.merge_duplicates(products, prices, decisions)
    assert sorted(map(tuple, left.collect())) == [(1, "Best", None), (4, "B", "y")]
    assert sorted(map(tuple, moved.select("product_id", "price").collect())) == [(1, 1.0), (4, 2.0)]


def test_ingest_makes_its_items_once(spark):
    """Each item is made once, however many steps look at it; items without a code stay."""
    import datetime

    from pyspark.sql import functions as F

    from pricelattice.operators import chains

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        made.add(1)
        return name

    day = datetime.datetime(2024, 1, 1)
    rows = [(k, 1, ["Нова", "мляко", "сирене"][k % 3], "A", None, [" 7 ", "", None, "8"][k % 4], 1, 2.0, day) for k in range(24)]
    items = spark.createDataFrame(rows, "load_key long, load_line int, name string, brand string, pack_info string, barcode string, store_id long, price double, recorded_at timestamp")
    products = spark.createDataFrame([(5, "хляб", "B", None, "7")], "product_id long, name string, brand string, pack_info string, barcode string")
    prices = spark.createDataFrame([(5, 1, "A", day - datetime.timedelta(days=1))], "product_id long, store_id long, brand string, recorded_at timestamp")
    out = chains.ingest(items.withColumn("name", seen.asNondeterministic()("name")), products, prices).collect()
    assert made.value == 24
    want = {k: None if k % 3 == 0 else "barcode" if k % 4 == 0 else "new" for k in range(24)}
    assert {r.load_key: r.matched_by for r in out} == want and len(out) == 24


def test_listing_prices_match_each_text_once(spark):
    """The optimizer copies no price's match to each use of it, and the cards are dealt to all cores."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cards = spark.createDataFrame([("2,50 €", "5,00 €"), (None, "3,00 €"), (None, None)], "promo_eur_text string, strike_eur_text string")
    out = listing_prices(cards)
    assert plan(out).count("regexp_extract(promo_eur_text") == plan(out).count("regexp_extract(strike_eur_text") == 1
    assert [(float(r.price), r.discount_percent) for r in out.collect()] == [(2.5, 50), (3.0, None)]
    assert "Repartition 200" in plan(Q.QUERIES["listing_offers"](spark, "/root/testdata/sf0.001"))
