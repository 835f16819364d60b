"""Catalog, taxonomy and listing cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.listing import TAXONOMY, listing_title
from ..functions.text import article_id, larger_image, normalise_title
from .offers import listing_prices

CARD = "name STRING, href STRING, image_src STRING, pack_info STRING, promo_eur_text STRING, strike_eur_text STRING, promo_label STRING"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries of CSV files with a head line and the columns name and category."""
    return catalog_entries(spark.read.option("header", True).schema("name STRING, category STRING").csv(path))


def catalog_entries(rows: DataFrame) -> DataFrame:
    """``(name, category, normalised)`` of named rows; a missing category is empty."""
    named = rows.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    return named.select("name", F.coalesce("category", F.lit("")).alias("category"), normalise_title(F.col("name")).alias("normalised"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """``(category, top_category)`` of every sub-category."""
    return spark.createDataFrame([(sub, top) for top, subs in TAXONOMY.items() for sub in subs], "category STRING, top_category STRING")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Listing cards of JSON lines."""
    return spark.read.schema(CARD).json(path)


def listing_offers(cards: DataFrame) -> DataFrame:
    """Offers of cards: the title split, the price and discount, the article id as barcode, the larger image. Cards without a
    name or a price go; other columns stay."""
    named = cards.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    split = named.withColumn("__t", listing_title(F.col("name"), F.col("pack_info")))
    parts = split.withColumns({c: F.col(f"__t.{c}") for c in ("name", "brand", "pack_info")}).drop("__t")
    links = parts.withColumns({"barcode": article_id(F.col("href")), "image_url": larger_image(F.col("image_src"))})
    return listing_prices(links)
