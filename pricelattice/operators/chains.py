"""The ingest and the merge of duplicates as chains of the single steps, and rows of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.listing import ascii_slug, is_brand_name
from ..functions.names import is_product_name, pack_components
from ..functions.text import brand_key, canonical_brand, name_slug, normalise_name, normalise_pack
from ..sources.facts import append_batch
from ..sources.shared import kept
from .order import first_of_group
from .prices import cheapest_store, latest_prices
from .resolve import catalog_hits, match_barcode, match_sku, similar_names
from .tables import enrich_columns, guarded, merge_products, product_key, search_or_part


def without_brand_names(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """``items`` with ``rejected``: the name is the brand (or the brand in Cyrillic) and no name of the catalog."""
    known = catalog.select(F.lower("name").alias("__known")).distinct()
    marked = items.join(known, F.lower(F.trim("name")) == F.col("__known"), "left")
    return marked.withColumn("rejected", is_brand_name(F.col("name"), F.col("brand")) & F.col("__known").isNull()).drop("__known")


def resolve_slug(products: DataFrame, slug: str) -> DataFrame:
    """The active name (the least, if several) whose slug is ``slug``: one row, or none."""
    names = products.where("status = 'active'").select("name").distinct().where(name_slug(F.col("name")) == slug)
    return names.agg(F.min("name").alias("name")).where("name is not null")


def search_compare(products: DataFrame, prices: DataFrame, stores: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The first ``most`` hits by name, or products whose name holds the query if there is no hit, each with its cheapest
    store now and the number of stores that sell it; hits that nobody sells go. The hits are ``most`` rows, so they are broadcast."""
    found = search_or_part(products, query, ("name",)).orderBy("name", "product_id").limit(most)
    hits = F.broadcast(found.select("product_id", "name", F.col("brand").alias("own_brand")))
    own = prices.join(hits.select("product_id"), "product_id")
    n = latest_prices(own).groupBy("product_id").agg(F.countDistinct("store_id").alias("n_stores"))
    best = cheapest_store(own, stores).select("product_id", "store_id", "store_name", "price")
    return best.join(n, "product_id").join(hits, "product_id").select("product_id", "name", "own_brand", "store_id", "store_name", "price", "n_stores")


def family_extras(products: DataFrame, prices: DataFrame, categories: DataFrame) -> DataFrame:
    """Per active name with a latest price: ``image``, the first non-empty one in order of price (of the price, else of the
    product), and the category of the product with the least id that has one."""
    own = products.where("status = 'active'").select("product_id", "name", "category_id", F.col("image_url").alias("own_image"))
    now = latest_prices(prices).select("product_id", "price", "load_key", "load_line", F.col("image_url").alias("price_image"))
    image = F.coalesce(F.nullif("price_image", F.lit("")), F.nullif("own_image", F.lit("")))
    rows = now.join(own, "product_id").withColumn("image", image)
    place = F.when(F.col("image").isNotNull(), F.struct("price", "load_key", "load_line"))
    first = F.when(F.col("category_id").isNotNull(), F.col("product_id"))
    names = rows.groupBy("name").agg(F.min_by("image", place).alias("image"), F.min_by("category_id", first).alias("category_id"))
    labels = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return names.join(labels, "category_id", "left").select("name", "image", "category_id", "category_name")


def ingest(items: DataFrame, products: DataFrame, prices: DataFrame) -> DataFrame:
    """The outcome of ``ingest_rows``, without the items' other columns."""
    return ingest_rows(items, products, prices).select("load_key", "load_line", "product_id", "matched_by", "outcome")


def ingest_rows(items: DataFrame, products: DataFrame, prices: DataFrame) -> DataFrame:
    """Every item ``(load_key, load_line, name, brand, pack_info, barcode, store_id, price, recorded_at)`` with its product
    and outcome. Names that are none are ``rejected``. Brands become canonical; the product is that of the barcode, else of
    the fuzzy match (of equally good ones one of the item's own pack), else a new one named by a hash of the key. Of a product, store, brand and day one price is
    ``inserted``, unless ``prices`` has it; others are ``skipped``. Repeated rows are items of their own; other columns
    stay. ``ingest_batch`` matches catalog names before, and appends what is inserted."""
    code = F.nullif(F.trim("barcode"), F.lit(""))
    codes = products.select(code.alias("barcode"), code.alias("item_no")).where("barcode is not null").distinct()
    by_code = match_barcode(codes, products).select(F.col("item_no").alias("__code"), F.col("product_id").alias("by_code"), F.lit(0).alias("__spread"))
    spread = F.when(code.isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("load_key", "load_line"), F.lit(1024)).cast("int"))  # no code: over all tasks
    rows = items.withColumns({"brand": canonical_brand(F.col("brand")), "__code": code, "__spread": spread})
    told = rows.join(by_code, ["__code", "__spread"], "left").drop("__code", "__spread")
    told = kept(told.withColumn("__good", is_product_name(F.col("name"))), "ingest-coded")  # items are made once
    coded = told.where("__good").drop("__good")
    own = ["name", "brand", "pack_info"]
    rest = kept(coded.where("by_code is null").select(*own).distinct(), "ingest-names")
    fuzzy = match_sku(rest.withColumn("item_no", F.struct(*own)), products, own_pack_first=True).select(*[F.col(f"item_no.{c}").alias(f"f_{c}") for c in own], F.col("product_id").alias("by_name"))
    alike = [F.col("by_code").isNull(), *[F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in own]]
    found = coded.join(fuzzy, alike, "left").withColumn("known_id", F.coalesce("by_code", "by_name"))
    parts = [normalise_name(F.col("name")), brand_key(F.col("brand")), normalise_pack(F.col("pack_info"))]
    placed = found.withColumn("product_id", F.coalesce(F.col("known_id").cast("string"), product_key(*parts)))
    how = F.when(F.col("by_code").isNotNull(), "barcode").when(F.col("by_name").isNotNull(), "name").otherwise("new")
    done = guarded(placed.withColumn("matched_by", how), prices.withColumn("product_id", F.col("product_id").cast("string")))
    out = [*items.columns, "product_id", "matched_by", "outcome"]
    none = F.lit(None).cast("string")
    gone = told.where("not __good").withColumns({"product_id": none, "matched_by": none, "outcome": F.lit("rejected")})
    return done.select(*out).unionByName(gone.select(*out))


def ingest_batch(
    items: DataFrame, products: DataFrame, prices: DataFrame, catalog: DataFrame, path: str, batch: str, decisions: DataFrame | None = None, every: str = "day",
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The whole ingest of a batch: ``(outcomes, products, counts)``.

    ``items`` are those of ``ingest_rows`` with ``category``, ``image_url`` and ``additional_info``. Names that are a brand alone, or no name, are rejected;
    brands become canonical; names that the catalog knows become its names, with its category (a decision may also give brand, pack and additional
    information); products are found by barcode, by name, or are new; a product, store, brand and day has one price; the prices that are
    inserted are appended to the facts at ``path`` (nothing changes where the batch is there); empty categories, images and additional information of products
    are filled from the first inserted item that has them, and new products are added as pending. ``outcomes`` has a row for each item; ``counts`` is observed
    while it is written: items, inserted, skipped, rejected, and by_barcode, by_name, by_new of those that were placed."""
    cleared = without_brand_names(items, catalog)
    hits = catalog_hits(items.select(F.col("name").alias("title")), catalog.withColumn("category", F.coalesce("category", F.lit(""))), decisions)
    told = hits.select(F.col("title").alias("name"), "catalog_name", F.col("category").alias("catalog_category"), *[c for c in hits.columns if c.startswith("decided_")])
    named = cleared.join(told, "name", "left")
    fields = {c: F.coalesce(f"decided_{c}", c) for c in ("brand", "pack_info", "additional_info")}
    title = F.when(F.col("rejected"), F.lit("")).otherwise(F.coalesce("catalog_name", "name"))  # a name that is none
    ready = named.withColumns({**fields, "name": title, "category": F.coalesce(F.nullif("catalog_category", F.lit("")), "category")})
    ready = kept(ready.select(*items.columns), "ingest-items")
    seen = Observation()
    is_ = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    counts = [F.count(F.lit(1)).alias("items"), *[is_("outcome", v).alias(v) for v in ("inserted", "skipped", "rejected")], *[is_("matched_by", v).alias(f"by_{v}") for v in ("barcode", "name", "new")]]
    outcomes = kept(ingest_rows(ready, products, prices).observe(seen, *counts), "ingest-outcomes")
    inserted = outcomes.where("outcome = 'inserted'")
    append_batch(inserted, path, batch, every=every)
    pack = pack_components(F.col("pack_info"))
    newest = outcomes.where("matched_by = 'new'").groupBy("product_id").agg(F.min_by(F.struct("name", "brand", "pack_info", "barcode"), F.struct("load_key", "load_line")).alias("x"))
    fresh = newest.select(
        "product_id", "x.*", ascii_slug(F.col("x.name"), F.col("x.barcode"), F.col("product_id")).alias("slug"), F.lit("pending_review").alias("status")
    ).withColumns({"generic_pack": pack["generic_pack"], "pack_type": pack["pack_type"]})
    every_one = products.withColumn("product_id", F.col("product_id").cast("string")).unionByName(fresh, allowMissingColumns=True)
    every_one = enrich_columns(every_one, inserted, ["category", "image_url", "additional_info"])
    return outcomes, every_one, {k: int(v) for k, v in seen.get.items()}


def accepted_links(decisions: DataFrame) -> DataFrame:
    """``(id_a, id_b, canonical_name)`` with id_a < id_b of pairs that are to be merged, whichever way round they were asked. A pair merges if no
    decision on it refuses; its name is the least one given. A pair of a product with itself is none."""
    pairs = decisions.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.coalesce("merge", F.lit(False)).alias("merge"), "canonical_name")
    one = pairs.groupBy("id_a", "id_b").agg(F.min("merge").alias("merge"), F.min("canonical_name").alias("canonical_name"))
    return one.where("merge").drop("merge")


def merge_duplicates(products: DataFrame, prices: DataFrame, decisions: DataFrame, created: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Products and prices after the merges of ``decisions(id_a, id_b, merge, canonical_name)``, chains and cycles in one pass: all products that
    accepted decisions link become the earliest ``created`` one of them (unknown times last, then the least id; without ``created`` the least id
    alone), which takes the canonical name of its group's first decision that has one, by its two ids. Decisions on unknown products do not count."""
    born = F.struct(F.col(created).isNull(), F.col(created), "product_id") if created else F.struct("product_id")
    known = products.select(F.col("product_id").alias("id"), born.alias("rank"))
    yes = accepted_links(decisions)
    side = lambda c, to: known.select(F.col("id").alias(c), F.col("rank").alias(to))
    links = kept(yes.join(side("id_a", "a"), "id_a").join(side("id_b", "b"), "id_b"), "merge-links")
    groups = first_of_group(links).select(F.col("a.product_id").alias("product_id"), F.col("up.product_id").alias("kept_id"))
    groups = kept(groups, "merge-groups")
    left, moved = merge_products(products, prices, groups)
    ends = links.where("canonical_name is not null").join(groups, F.col("id_a") == F.col("product_id"), "left")
    first = F.min_by("canonical_name", F.struct("id_a", "id_b")).alias("__name")
    names = ends.groupBy(F.coalesce("kept_id", "id_a").alias("product_id")).agg(first)
    return left.join(names, "product_id", "left").withColumn("name", F.coalesce("__name", "name")).drop("__name"), moved


def merge_candidates(products: DataFrame, created: str, least: float = 80.0) -> DataFrame:
    """``(id_a, id_b, name_a, name_b, score)`` to be decided on: products of an equal normalised name with the first of them, and the first ones of
    similar names with each other. They hold together every group that all pairs of products would."""
    own = products.select("product_id", F.col(created).alias("born"), "name", normalise_name(F.col("name")).alias("n")).where("n <> ''")
    first = own.groupBy("n").agg(F.min_by(F.struct("product_id", "name"), F.struct(F.col("born").isNull(), "born", "product_id")).alias("x"))
    heads = kept(first.select("n", F.col("x.product_id").alias("head"), F.col("x.name").alias("head_name")), "merge-heads")
    equal = own.join(heads, "n").where("product_id <> head").select(F.col("head").alias("id_a"), F.col("product_id").alias("id_b"), F.col("head_name").alias("name_a"), F.col("name").alias("name_b"), F.lit(100.0).alias("score"))
    side = lambda n, i, c: heads.select(F.col("n").alias(n), F.col("head").alias(i), F.col("head_name").alias(c))
    alike = similar_names(products.select("name"), least).join(side("a", "id_a", "name_a"), "a").join(side("b", "id_b", "name_b"), "b")
    return equal.unionByName(alike.select("id_a", "id_b", "name_a", "name_b", "score"))


def equal_products(products: DataFrame) -> DataFrame:
    """``(id_a, id_b)``: the first product of an equal normalised name, brand and pack with each other one: links that hold a group
    together without all of its pairs."""
    own = products.select("product_id", normalise_name(F.col("name")).alias("n"), brand_key(F.col("brand")).alias("b"), normalise_pack(F.col("pack_info")).alias("p"))
    w = Window.partitionBy("n", "b", "p")
    first = own.withColumn("id_a", F.min("product_id").over(w))
    return first.where("n <> '' and id_a <> product_id").select("id_a", F.col("product_id").alias("id_b"))
