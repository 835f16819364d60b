"""Semi-structured inputs of the ingest: extraction responses, merge decisions, listing cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import title_case

#: All fields as text, parsed leniently afterwards.
ITEM = (
    "name STRING, is_product BOOLEAN, brand STRING, product_type STRING, category STRING, price STRING, original_price STRING, "
    "discount_percent STRING, currency STRING, pack_info STRING, valid_from STRING, valid_to STRING"
)


def without_fences(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"```[a-z]*\n?", ""))


def extraction_offers(responses: DataFrame) -> DataFrame:
    """Offers of ``responses(page, response)``: JSON with an ``items`` array, with or without code fences. Rows that
    are no product, have no name or no price that parses are dropped; so are responses that do not parse."""
    items = F.from_json(without_fences(F.col("response")), f"items ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN')}>>")["items"]
    rows = responses.select("page", F.posexplode(items).alias("item_no", "x")).select("page", "item_no", "x.*")
    price = F.col("price").try_cast("decimal(10,2)")
    return (
        rows.where(F.coalesce("is_product", F.lit(True)) & (F.trim(F.coalesce("name", F.lit(""))) != "") & price.isNotNull())
        .withColumn("price", price)
        .withColumn("original_price", F.col("original_price").try_cast("decimal(10,2)"))
        .withColumn("discount_percent", F.col("discount_percent").try_cast("decimal(6,2)").cast("int"))
        .withColumn("valid_from", F.try_to_date("valid_from", "yyyy-MM-dd"))
        .withColumn("valid_to", F.try_to_date("valid_to", "yyyy-MM-dd"))
        .drop("is_product")
    )


def merge_decisions(raw: DataFrame) -> DataFrame:
    """Decisions of ``raw(id_a, id_b, response)``; what does not parse is no merge."""
    x = F.from_json(without_fences(F.col("response")), "merge BOOLEAN, canonical_name STRING, reason STRING")
    return raw.select(
        "id_a", "id_b", F.coalesce(x["merge"], F.lit(False)).alias("merge"),
        F.nullif(x["canonical_name"], F.lit("")).alias("canonical_name"), F.coalesce(x["reason"], F.lit("parse error")).alias("reason"),
    )


def clean_offers(items: DataFrame) -> DataFrame:
    """Offers with their ``name`` in title case, ``unit`` and ``barcode`` without space around them, and EUR where ``currency`` is null or empty."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    currency = F.coalesce(F.nullif("currency", F.lit("")), F.lit("EUR"))
    return items.withColumns({"name": title_case(F.col("name")), "unit": bare("unit"), "barcode": bare("barcode"), "currency": currency})


def log_entries(raw: DataFrame, column: str = "entry") -> DataFrame:
    """``raw`` with ``ts``, ``store``, ``level`` and ``msg`` of the JSON object in ``column``. Absent fields are empty, an absent level is INFO.
    Entries that are no JSON object, or where one of the four is no string, are dropped."""
    doc = F.try_parse_json(column)
    field = lambda k: F.try_variant_get(doc, f"$.{k}", "variant")
    names = {"ts": "", "store": "", "level": "INFO", "msg": ""}
    good = F.schema_of_variant(doc).startswith("OBJECT<")
    for k in names:
        good = good & (field(k).isNull() | (F.schema_of_variant(field(k)) == "STRING"))
    return raw.where(good).withColumns({k: F.coalesce(F.try_variant_get(doc, f"$.{k}", "string"), F.lit(v)) for k, v in names.items()})


def listing_prices(cards: DataFrame) -> DataFrame:
    """Cards with ``price`` (the promotional one, else the crossed-out one) and ``discount_percent``; cards without a price go."""
    euro = lambda c: F.replace(F.regexp_extract(c, r"([\d]+[.,][\d]{1,2})\s*€", 1), F.lit(","), F.lit(".")).try_cast("decimal(10,2)")
    # a row of a generator, so that each text is matched once, not once for each use of its number
    read = cards.withColumn("__p", F.explode(F.array(F.struct(euro(F.col("promo_eur_text")).alias("promo"), euro(F.col("strike_eur_text")).alias("strike")))))
    promo, strike = F.col("__p.promo"), F.col("__p.strike")
    both = (promo > 0) & (strike > 0)
    out = read.withColumn("price", F.coalesce(F.nullif(promo, F.lit(0)), strike))
    return out.withColumn("discount_percent", F.when(both, F.bround((1 - promo / strike) * 100, 0).cast("int"))).where("price is not null").drop("__p")
