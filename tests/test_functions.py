"""Literal cases of the scalar functions."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricelattice.functions import dates, packs, text
from pricelattice.operators.prices import weekly
from pricelattice.operators.tables import page_runs

CASES = [
    (text.normalise_name, "HELLO WORLD", "hello world"),
    (text.normalise_name, " hello,  world! ", "hello world"),
    (text.normalise_name, "Бира (тъмна)", "бира тъмна"),
    (text.normalise_title, "бира,тъмна", "бира тъмна"),
    (text.normalise_pack, " 1,5  КГ ", "1.5 кг"),
    (text.normalise_pack, "  ", None),
    (text.canonical_brand, " Нестле ", "Nestlé"),
    (text.canonical_brand, "Own", "Own"),
    (text.canonical_brand, None, None),
    (text.name_slug, "Щипки & Яйца 10", "shtipki-yaytsa-10"),
    (text.name_slug, "!!", "product"),
    (text.currency_code, "лв", "EUR"),
    (text.currency_code, "", "EUR"),
    (text.currency_code, "usd", "USD"),
    (text.source_code, "brochure", "brochure"),
    (text.source_code, "listing", "web"),
    (text.article_id, "/shop/pv/BTY-X335615/0032/", "BTY-X335615"),
    (text.article_id, "/shop/", None),
    (text.larger_image, "a?w=144&h=144", "a?w=400&h=400"),
    (text.next_section, "http://x/ar/0?p=1", "http://x/ar/1?p=1"),
    (text.next_section, "http://x/0", None),
    (packs.pack_base, "6 x 500 мл", "л"),
    (packs.pack_base, "нищо", None),
    (packs.pack_size, "6 x 500 мл", Decimal("3.000000")),
    (packs.pack_size, "1,5 КГ", Decimal("1.500000")),
    (packs.first_price, "Мляко 1.89 лв.", Decimal("1.89")),
    (packs.first_price, "Сирене 3,49 лв", Decimal("3.49")),
    (packs.first_price, "Промо 5.00лв", Decimal("5.00")),
    (packs.first_price, "страница 5", None),
]


@pytest.mark.parametrize("function,value,want", CASES)
def test_case(spark, function, value, want):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(function(F.col("x"))).first()[0] == want


def test_unit_price_and_plausibility(spark):
    df = spark.createDataFrame([(Decimal("2.49"), "500 г", "Плодове"), (Decimal("9.00"), "0.5 кг", "Плодове"), (Decimal("1.00"), None, None)], "p decimal(10,2), k string, c string")
    got = df.select(packs.unit_price(F.col("p"), F.col("k")), packs.plausible(F.col("p"), F.col("k"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(Decimal("4.98"), True), (Decimal("18.00"), False), (None, True)]


def test_weekly_buckets(spark):
    days = [datetime.datetime(2026, 3, d) for d in (1, 2, 8, 9)]
    df = spark.createDataFrame([(1, 1, d, Decimal(k + 1)) for k, d in enumerate(days)], "product_id int, store_id int, recorded_at timestamp_ntz, price decimal(12,2)")
    got = [(r.first_date, r.avg_price) for r in weekly(df).orderBy("first_date").collect()]
    assert got == [(days[0].date(), Decimal("1.00")), (days[1].date(), Decimal("2.50")), (days[3].date(), Decimal("4.00"))]


@pytest.mark.parametrize("value", ["01.04 - 07.04", "01.04.2026 – 07.04.2026", "01/04/2026 до 07/04/2026", "01.04—07.04", "01.04.26-07.04.26"])
def test_date_ranges(spark, value):
    got = spark.createDataFrame([(value,)], "x string").select(dates.date_range(F.col("x"), 2026).alias("r")).select("r.*").first()
    assert tuple(got) == (datetime.date(2026, 4, 1), datetime.date(2026, 4, 7))


def test_no_date_range(spark):
    got = spark.createDataFrame([("31.02 - 07.04",), ("none",)], "x string").select(dates.date_range(F.col("x"), 2026).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [(None, None)] * 2


def test_page_runs(spark):
    rows = [(1, k, c) for k, c in enumerate("aabbbcddddeee")]
    got = page_runs(spark.createDataFrame(rows, "seq_id int, page_no int, content string")).orderBy("page_no").collect()
    assert "".join(r.content for r in got) == "abcd"


def test_no_break_space(spark):
    row = spark.range(1).select(
        packs.pack_size(F.lit("500\u00a0г")).alias("size"), packs.first_price(F.lit("12\u00a099 лв")).alias("price"),
        dates.date_range(F.lit("01.04\u00a0-\u00a007.04"), 2026).alias("r"),
    ).first()
    assert float(row["size"]) == 0.5 and float(row["price"]) == 12.99 and str(row.r.valid_to) == "2026-04-07"
