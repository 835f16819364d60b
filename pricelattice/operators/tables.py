"""Categories, runs, brochures, ingest, moderation and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import split_brand
from .prices import latest, modal_brand


def category_tree(categories: DataFrame, max_depth: int = 16) -> DataFrame:
    """Every category with its depth and its path of names, level by level from the roots. A tree
    deeper than ``max_depth`` raises."""
    level = categories.where("parent_id is null").select("id", "name", "parent_id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    levels = [level]
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("id").alias("up"), F.col("path").alias("up_path"))
        level = categories.join(up, F.col("parent_id") == F.col("up")).select(
            "id", "name", "parent_id", F.lit(depth).alias("depth"), F.concat_ws(" > ", "up_path", "name").alias("path")
        )
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
    raise ValueError(f"the tree is deeper than {max_depth}")


def in_subtree(categories: DataFrame, root: int, max_depth: int = 16) -> DataFrame:
    """Ids of a category and all below it. A cycle, or a tree deeper than ``max_depth``, raises."""
    found = categories.where(F.col("id") == root).select("id")
    level = found
    for depth in range(max_depth + 2):
        if level.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"the tree is deeper than {max_depth}")
        level = categories.join(level.withColumnRenamed("id", "up"), F.col("parent_id") == F.col("up")).select("id")
        found = found.unionByName(level)
    return found


def run_status(stores: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest run of each active store; `idle` for stores without one."""
    last = latest(runs, ["store_id"], "started_at", [F.desc("run_id")])
    out = stores.where("active").join(last, "store_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("idle")))


def run_alerts(status: DataFrame) -> DataFrame:
    """Stores whose latest run failed, or completed without an item."""
    return status.where("status = 'failed' or (status = 'completed' and items_found = 0)")


def reap_stale(runs: DataFrame, heartbeats: DataFrame, now: Column, seconds: int = 1800) -> DataFrame:
    """Runs; running ones without a heartbeat of their store within ``seconds`` become failed."""
    beat = heartbeats.groupBy("store_id").agg(F.max("ts").alias("beat"))
    late = F.coalesce(F.col("beat") < now - F.expr(f"interval {seconds} seconds"), F.lit(True))
    stale = (F.col("status") == "running") & late
    return (
        runs.join(beat, "store_id", "left")
        .withColumn("error_msg", F.when(stale, "no heartbeat"))
        .withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
        .drop("beat")
    )


def store_brochures(stores: DataFrame, brochures: DataFrame) -> DataFrame:
    """Each store with its current brochure that is valid from the latest day (unknown days first), or without."""
    w = Window.partitionBy("store_id").orderBy(F.desc_nulls_first("valid_from"), F.desc("brochure_id"))
    now = brochures.where("is_current").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "is_current")
    return stores.join(now, "store_id", "left")


def guarded(batch: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows of a batch whose product, store, brand and day have no price yet, one of each; ``outcome``
    says inserted or skipped."""
    day = F.to_date("recorded_at").alias("day")
    have = prices.select("product_id", "store_id", "brand", day).distinct().withColumn("have", F.lit(True)).alias("h")
    w = Window.partitionBy("product_id", "store_id", "brand", "day").orderBy("load_key", "load_line")
    rows = batch.withColumn("day", F.to_date("recorded_at")).withColumn("nth", F.row_number().over(w)).alias("b")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("product_id", "store_id", "brand", "day")]
    out = rows.join(have, same, "left").select("b.*", "have")
    return out.withColumn("outcome", F.when(F.col("have") | (F.col("nth") > 1), "skipped").otherwise("inserted")).drop("have", "nth", "day")


def insert_missing(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` and the rows of ``new`` whose key it lacks."""
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def enrich(products: DataFrame, batch: DataFrame, column: str, key: str = "product_id") -> DataFrame:
    """Fill a null ``column`` from the first row of the batch that has it; set values stay."""
    first = batch.where(F.col(column).isNotNull()).groupBy(key).agg(F.min_by(column, F.struct("load_key", "load_line")).alias("__new"))
    return products.join(first, key, "left").withColumn(column, F.coalesce(column, "__new")).drop("__new")


def enrich_columns(products: DataFrame, batch: DataFrame, columns: list[str], key: str = "product_id") -> DataFrame:
    """Fill the empty ``columns`` of products from the first row of the batch, by load key and line, that has the column: one pass over the
    batch and one join for all of them. An empty text counts as none; set values stay; a column that products lack is added."""
    place = F.struct("load_key", "load_line")
    own = products.withColumns({c: F.nullif(c, F.lit("")) if c in products.columns else F.lit(None).cast("string") for c in columns})
    value = lambda c: F.nullif(c, F.lit(""))
    first = batch.groupBy(key).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), place)).alias(f"__new_{c}") for c in columns])
    out = own.join(first, key, "left")
    return out.withColumns({c: F.coalesce(c, f"__new_{c}") for c in columns}).drop(*[f"__new_{c}" for c in columns])


def moderate(products: DataFrame, actions: DataFrame) -> DataFrame:
    """Approve or reject: approved products become active, rejected ones go if they are pending; others stay. Of several
    actions on a product a rejection counts."""
    one = actions.groupBy("product_id").agg(F.max("action").alias("action"))
    out = products.join(one, "product_id", "left")
    reject = F.coalesce((F.col("action") == "reject") & (F.col("status") == "pending_review"), F.lit(False))
    return (
        out.where(~reject)
        .withColumn("status", F.when(F.col("action") == "approve", "active").otherwise(F.col("status")))
        .drop("action")
    )


def rejections(products: DataFrame, asked: DataFrame, order: str) -> DataFrame:
    """What becomes of every request ``asked(product_id, ...)`` to reject: ``rejected`` for a pending product, ``not pending`` for another
    one, ``not found`` where there is none (any more: of several requests for a pending product the first in ``order`` takes it away).
    A null id is not found; equal places in ``order`` are all first."""
    status = products.select("product_id", F.coalesce("status", F.lit("")).alias("__status"))
    first = asked.where("product_id is not null").groupBy("product_id").agg(F.min(order).alias("__first"))
    out = asked.join(first.join(status, "product_id"), "product_id", "left")
    pending = F.col("__status") == "pending_review"
    gone = F.col("__status").isNull() | (pending & (F.col(order) > F.col("__first")))
    return out.withColumn("outcome", F.when(gone, "not found").when(pending, "rejected").otherwise("not pending")).drop("__status", "__first")


def update_partial(products: DataFrame, updates: DataFrame, columns: list[str], key: str = "product_id", order: str | None = None) -> DataFrame:
    """Set the given columns where the update has a value. Of several updates of a key the last one in ``order`` counts, whole (without an
    order, and among equals of it, the greatest one, columns compared from left to right)."""
    row = F.struct(*([F.col(order).alias("__order")] if order else []), *columns)
    new = updates.groupBy(key).agg(F.max(row).alias("__new"))
    out = products.join(new, key, "left")
    return out.withColumns({c: F.coalesce(F.col(f"__new.{c}"), c) for c in columns}).drop("__new")


def delete_cascade(products: DataFrame, prices: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products and prices without the products of ``gone``."""
    ids = gone.select("product_id")
    return products.join(ids, "product_id", "left_anti"), prices.join(ids, "product_id", "left_anti")


def merge_products(products: DataFrame, prices: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merged(product_id, kept_id)``: prices move to the kept product, whose brand becomes null; the
    others go. A product merged into itself stays as it is."""
    merged = merged.where("product_id <> kept_id")
    moved = prices.join(merged, "product_id", "left").withColumn("product_id", F.coalesce("kept_id", "product_id")).drop("kept_id")
    keep = merged.select(F.col("kept_id").alias("product_id")).distinct().withColumn("__kept", F.lit(True))
    left = products.join(merged, "product_id", "left_anti").join(keep, "product_id", "left")
    return left.withColumn("brand", F.when(F.col("__kept").isNull(), F.col("brand"))).drop("__kept"), moved


def search(products: DataFrame, query: str) -> DataFrame:
    """Active products whose name and brand hold every word of the query."""
    words = F.split(F.lower(F.concat_ws(" ", "name", "brand")), r"(?U)[^\p{L}\p{N}]+")
    hits = [F.array_contains(words, w) for w in query.lower().split()]
    return products.where("status = 'active'").where(reduce(Column.__and__, hits, F.lit(True)))


def search_or_part(products: DataFrame, query: str, columns: tuple[str, ...] = ("name", "brand")) -> DataFrame:
    """The hits of ``search``; if there is none, active products one of whose ``columns`` holds the query as it is."""
    hits = search(products, query)
    like = lambda c: F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    part = products.where("status = 'active'").where(reduce(Column.__or__, map(like, columns)))
    none = hits.agg((F.count("*") == 0).alias("__none"))  # one row
    return hits.unionByName(part.join(F.broadcast(none), F.col("__none")).drop("__none"))


def backfill_category(products: DataFrame, prices: DataFrame) -> DataFrame:
    """``category`` of each product: that of its latest price that has one."""
    known = latest(prices.where("category is not null"), ["product_id"], "recorded_at", [F.desc("load_key"), F.desc("load_line")])
    return products.join(known.select("product_id", "category"), "product_id", "left")


def backfill_category_id(products: DataFrame, prices: DataFrame, categories: DataFrame) -> DataFrame:
    """Products whose null ``category_id`` becomes that of the category named by their latest price that has one; a name that no category has
    leaves it null. Of categories of one name the least id counts; of equal times the last load key and line."""
    bare = products.where("category_id is null").select("product_id")
    rows = prices.join(bare, "product_id", "left_semi").where("category is not null")
    last = rows.groupBy("product_id").agg(F.max_by("category", F.struct("recorded_at", "load_key", "load_line")).alias("name"))
    ids = categories.groupBy("name").agg(F.min("id").alias("__id"))
    return products.join(last.join(ids, "name").drop("name"), "product_id", "left").withColumn("category_id", F.coalesce("category_id", "__id")).drop("__id")


def backfill_brands(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Products without a brand: a name that begins with a Latin word and goes on in Cyrillic gives brand and name; where
    there is still none, the most frequent brand of the product's prices (the least of equally frequent ones). Set brands, and their names, stay."""
    found = split_brand(F.col("name"))
    bare = F.col("brand").isNull()
    split = products.withColumns({"brand": F.coalesce("brand", found["brand"]), "name": F.when(bare, found["name"]).otherwise(F.col("name"))})
    need = split.where("brand is null").select("product_id")
    modal = modal_brand(prices.join(need, "product_id", "left_semi")).select("product_id", F.col("brand").alias("__modal"))
    return split.join(modal, "product_id", "left").withColumn("brand", F.coalesce("brand", "__modal")).drop("__modal")


def page_dedup(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The first of the lines of a page that agree without case and surrounding space, and in the columns ``also`` (such as the price)."""
    w = Window.partitionBy("page_id", F.lower(F.trim("line")), *also).orderBy("line_no")
    return lines.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def page_runs(pages: DataFrame, stop_at: int = 3) -> DataFrame:
    """Pages ``(seq_id, page_no, content)`` without consecutive repeats; a sequence ends before its
    ``stop_at``-th repeat in a row."""
    w = Window.partitionBy("seq_id").orderBy("page_no")
    digest = F.md5(F.col("content"))
    marked = pages.withColumn("new", F.coalesce(digest != F.lag(digest).over(w), F.lit(True)))
    grouped = marked.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy("seq_id", "run").orderBy("page_no")) - 1
    ended = F.max((F.col("place") >= stop_at).cast("int")).over(w)
    return grouped.withColumn("place", place).withColumn("ended", ended).where("ended = 0 and new").drop("new", "run", "place", "ended")


def priced_blocks(lines: DataFrame, price: Column) -> DataFrame:
    """Lines ``(page_id, line_no, line)`` with a price, each with up to two lines above it as its block."""
    w = Window.partitionBy("page_id").orderBy("line_no")
    block = F.concat_ws("\n", F.lag("line", 2).over(w), F.lag("line", 1).over(w), F.col("line"))
    return lines.withColumn("block", block).withColumn("price", price).where("price is not null")


def product_key(name: Column, brand: Column, pack: Column) -> Column:
    """The id of a new product: a hash of its normalised name, brand and pack."""
    return F.sha2(F.concat_ws("|", name, brand, pack), 256)


def new_products(unmatched: DataFrame, name: Column, brand: Column, pack: Column) -> DataFrame:
    """One pending product per normalised name, brand and pack of unmatched items; its id is a hash of the
    key, so that reruns agree."""
    keyed = unmatched.select("item_no", name.alias("name"), brand.alias("brand"), pack.alias("pack_info"))
    one = keyed.groupBy("name", "brand", "pack_info").agg(F.count("*").alias("n_items"), F.min("item_no").alias("first_item"))
    return one.withColumn("status", F.lit("pending_review")).withColumn("product_key", product_key(*map(F.col, ("name", "brand", "pack_info"))))


def review_queue(products: DataFrame, prices: DataFrame, stores: DataFrame) -> DataFrame:
    """Pending products with the names of the stores that ever sold them and their latest price."""
    pending = products.where("status = 'pending_review'")
    own = prices.join(pending.select("product_id"), "product_id", "left_semi")
    sold = own.select("product_id", "store_id").distinct().join(stores.select("store_id", "store_name"), "store_id")
    names = sold.groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_set("store_name")), "|").alias("stores"))
    last = latest(own, ["product_id"], "recorded_at", [F.desc("load_key"), F.desc("load_line")]).select("product_id", F.col("price").alias("last_price"))
    return pending.join(names, "product_id", "left").join(last, "product_id", "left")
