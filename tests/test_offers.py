import datetime
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from pricelattice.functions import names
from pricelattice.sources import offers


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("r")).first()[0]


def test_names(spark):
    assert [one(spark, x, names.is_product_name) for x in ("Българска", "Хляб", "Мляко", "я", None)] == [True, True, True, False, False]
    assert [one(spark, x, names.is_product_name) for x in ("Български", "Нова", "Свежи")] == [False] * 3
    assert tuple(one(spark, "1 кг Кенче", names.pack_components)) == ("1 кг", "кенче")
    assert tuple(one(spark, "500 г", names.pack_components)) == ("500 г", None) and tuple(one(spark, None, names.pack_components)) == (None, None)
    assert tuple(one(spark, "Milka шоколад", names.split_brand)) == ("Milka", "шоколад")
    assert tuple(one(spark, "Milka bar", names.split_brand)) == (None, "Milka bar")
    assert one(spark, "Сирене", names.category_uuid) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "category:Сирене"))
    df = spark.createDataFrame([("Милка", "Milka"), ("Мляко прясно", "Milka"), ("Шоколадова", "Lay")], "n string, b string")
    assert [r[0] for r in df.select(names.is_transliteration(F.col("n"), F.col("b"))).collect()] == [True, False, False]


def test_extraction(spark):
    text = '```json\n{"items":[{"name":"A","price":"1.5","valid_from":"2026-04-01"},{"name":" ","price":"1"},{"name":"B","price":"x"},{"name":"C","price":2,"is_product":false}]}\n```'
    got = offers.extraction_offers(spark.createDataFrame([(1, text), (2, "broken"), (3, None)], "page int, response string")).collect()
    assert [(r.page, r.name, r.price, r.valid_from, r.valid_to) for r in got] == [(1, "A", Decimal("1.50"), datetime.date(2026, 4, 1), None)]


def test_decisions_and_cards(spark):
    raw = spark.createDataFrame([(1, 2, '```json\n{"merge": true, "canonical_name": "", "reason": "same"}```'), (1, 3, "no")], "id_a int, id_b int, response string")
    assert [(r.merge, r.canonical_name, r.reason) for r in offers.merge_decisions(raw).collect()] == [(True, None, "same"), (False, None, "parse error")]
    cards = spark.createDataFrame([("1,50 €", "2.00 €"), (None, "2.00 €"), ("", "")], "promo_eur_text string, strike_eur_text string")
    assert [(r.price, r.discount_percent) for r in offers.listing_prices(cards).collect()] == [(Decimal("1.50"), 25), (Decimal("2.00"), None)]
