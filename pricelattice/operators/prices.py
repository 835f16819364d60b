"""Latest prices and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packs import pack_base, unit_price
from ..functions.text import brand_key, normalise_pack
from .order import half_even


#: Parts that prices are dealt to by product: a number that is not coalesced, so that a task's rows stay few in large tables.
PARTS = 200


def by_product(prices: DataFrame, *columns: str) -> DataFrame:
    return prices.select("product_id", *columns).repartition(PARTS, "product_id")


def latest(df: DataFrame, keys: list[str], order: str = "recorded_at", tie_break: list[Column] | None = None) -> DataFrame:
    """The rows with the greatest ``order`` of each key; all of them on ties, or one by ``tie_break``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *(tie_break or []))
    nth = F.row_number() if tie_break else F.rank()
    return df.withColumn("__nth", nth.over(w)).where("__nth = 1").drop("__nth")


def latest_prices(prices: DataFrame) -> DataFrame:
    return latest(prices, ["product_id", "store_id"])


def product_prices(prices: DataFrame) -> DataFrame:
    """Per product the least of its stores' latest prices, the number of its stores and its last update. Rows meet by product once; of each
    store one row stays, the cheapest of its latest ones, so that nothing is counted apart."""
    now = latest(by_product(prices, "store_id", "price", "recorded_at"), ["product_id", "store_id"], tie_break=[F.asc_nulls_last("price")])
    return now.groupBy("product_id").agg(F.min("price").alias("min_price"), F.count("store_id").alias("n_stores"), F.max("recorded_at").alias("updated_at"))


def compare(prices: DataFrame, stores: DataFrame, products: Column) -> DataFrame:
    """Latest prices of some products by store, with the percentage above the cheapest."""
    now = latest_prices(prices.where(products)).select("product_id", "store_id", "price", "load_key", "load_line")
    low = F.min("price").over(Window.partitionBy("product_id"))
    above = F.when(low == 0, F.lit(0)).otherwise(half_even((F.col("price") - low) * 100, low, 1))
    return now.join(stores, "store_id").withColumn("pct_above", above.cast("decimal(10,1)"))


def cheapest_store(prices: DataFrame, stores: DataFrame) -> DataFrame:
    w = Window.partitionBy("product_id").orderBy("price", "store_id", "load_key", "load_line")
    best = latest_prices(prices).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("product_id", "store_id", "price").join(stores, "store_id")


def product_summary(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Every product with its least latest price, its stores and its last update."""
    out = products.join(product_prices(prices), "product_id", "left")
    return out.withColumn("n_stores", F.coalesce("n_stores", F.lit(0)).cast("long"))


def deals(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Latest prices of active products that have a discount."""
    return latest_prices(prices).where("discount_percent > 0").join(
        products.where("status = 'active'").select("product_id", "name"), "product_id"
    )


def families(products: DataFrame, prices: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Rollup of active products by name. ``names`` chooses families; all their variants count. A product's latest prices become one row
    before its family is formed (the unit price grows with the price); stores are those with a price, as each has a latest one."""
    own = products.where("status = 'active'")
    if names is not None:
        own = own.join(names.select("name").distinct(), "name", "left_semi")
    rows = own.join(product_prices(prices), "product_id", "left").withColumn("ppu", unit_price(F.col("min_price"), F.col("pack_info")))
    sold = by_product(prices, "store_id").join(own.select("product_id", F.col("name").alias("__name")), "product_id")
    stores = sold.select("__name", "store_id").distinct().groupBy("__name").agg(F.count("store_id").alias("n_stores"))
    out = rows.groupBy("name").agg(
        F.countDistinct(brand_key(F.col("brand"))).alias("n_brands"),
        F.countDistinct(normalise_pack(F.col("pack_info"))).alias("n_packs"),
        F.countDistinct("product_id").alias("n_products"),
        F.min("min_price").alias("min_price"),
        F.min("ppu").alias("min_unit_price"),
        F.min_by(pack_base(F.col("pack_info")), F.when(F.col("ppu").isNotNull(), F.struct("ppu", "product_id"))).alias("unit"),
        F.max("updated_at").alias("updated_at"),
    )
    own_stores = out.join(stores, F.col("name").eqNullSafe(F.col("__name")), "left").withColumn("n_stores", F.coalesce("n_stores", F.lit(0)))
    return own_stores.select("name", "n_brands", "n_packs", "n_stores", "n_products", "min_price", "min_unit_price", "unit", "updated_at")


def family_variants(products: DataFrame, prices: DataFrame, name: str) -> DataFrame:
    own = products.where(F.col("name") == name).where("status = 'active'")
    now = latest_prices(prices.join(own.select("product_id"), "product_id", "left_semi"))
    return now.select("product_id", "store_id", "price", "load_key", "load_line").join(
        own.select("product_id", "brand", "pack_info"), "product_id"
    ).withColumn("unit_price", unit_price(F.col("price"), F.col("pack_info")))


def browse_brands(prices: DataFrame, products: DataFrame) -> DataFrame:
    """Latest prices of active products by top category, category, type and brand."""
    active = products.where("status = 'active'").select("product_id")
    rows = latest_prices(prices.where("top_category is not null")).join(active, "product_id", "left_semi")
    return (
        rows.groupBy(
            "top_category",
            "category",
            F.coalesce("product_type", F.lit("Общо")).alias("product_type"),
            F.coalesce("brand", F.lit("Собствена марка")).alias("brand"),
        )
        .agg(
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.max("discount_percent").alias("max_discount"),
            F.countDistinct("store_id").alias("n_stores"),
        )
    )


def browse_rollup(brands: DataFrame) -> DataFrame:
    """Price ranges at the three levels above the brands; null where a level is summed over."""
    return (
        brands.rollup("top_category", "category", "product_type")
        .agg(F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"), F.grouping_id().cast("int").alias("level"))
        .where("level < 7")
    )


def dedup_prices(prices: DataFrame, keep: str = "last") -> DataFrame:
    """One price per product, store and time: the last loaded, or with ``keep="lowest"`` the lowest."""
    order = [F.desc("load_key"), F.desc("load_line")] if keep == "last" else [F.asc("price"), F.desc("load_key"), F.desc("load_line")]
    w = Window.partitionBy("product_id", "store_id", "recorded_at").orderBy(*order)
    return prices.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def weekly(prices: DataFrame) -> DataFrame:
    """Mean price per product, store and ISO week; the date is the first seen in the week."""
    return (
        prices.groupBy("product_id", "store_id", F.to_date(F.date_trunc("week", "recorded_at")).alias("week"))
        .agg(F.sum("price").alias("total"), F.count("*").alias("n"), F.min(F.to_date("recorded_at")).alias("first_date"))
        .select("product_id", "store_id", "first_date", "n", half_even(F.col("total"), F.col("n"), 2).cast("decimal(12,2)").alias("avg_price"))
    )


def trend(prices: DataFrame, days: int) -> DataFrame:
    """First against last price per product in the last ``days`` days: up, down or stable."""
    last = prices.agg(F.max("recorded_at").alias("end"))
    rows = prices.join(F.broadcast(last), F.expr(f"recorded_at >= end - interval {days} days"))  # one row
    order = F.struct("recorded_at", "load_key", "load_line")
    agg = rows.groupBy("product_id").agg(
        F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"), F.count("*").alias("n")
    )
    up, down = F.col("last_price") * 100 > F.col("first_price") * 101, F.col("last_price") * 100 < F.col("first_price") * 99
    return agg.where("n >= 2").withColumn("trend", F.when(up, "up").when(down, "down").otherwise("stable"))


def modal_brand(prices: DataFrame) -> DataFrame:
    """The most frequent brand of each product, the least on ties."""
    n = prices.where("brand is not null").groupBy("product_id", "brand").agg(F.count("*").alias("n"))
    w = Window.partitionBy("product_id").orderBy(F.desc("n"), "brand")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
