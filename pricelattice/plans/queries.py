"""The registered queries over the price tables, each next to its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import load, with_tables
from ..functions import dates, packs, text
from ..operators import chains
from ..operators import order as O
from ..operators import prices as P
from ..operators import tables as T
from ..sources import facts
from ..sources.shared import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LATEST = "latest AS (SELECT * FROM prices QUALIFY rank() OVER (PARTITION BY product_id, store_id ORDER BY recorded_at DESC) = 1)"
PACK_RE = r"(?:(\d+(?:[.,]\d+)?)\s*[xх×]\s*)?(\d+(?:[.,]\d+)?)\s*(мл|ml|л|l|г|гр|g|кг|kg|бр)"
SIZED = f"""sized AS (
  SELECT product_id, CAST(replace(regexp_extract(pack_info, '{PACK_RE}', 2, 'i'), ',', '.') AS DECIMAL(12,3))
    * CASE WHEN regexp_extract(pack_info, '{PACK_RE}', 1, 'i') = '' THEN 1
           ELSE CAST(replace(regexp_extract(pack_info, '{PACK_RE}', 1, 'i'), ',', '.') AS DECIMAL(12,3)) END
    * CASE WHEN regexp_extract(pack_info, '{PACK_RE}', 3, 'i') IN ('мл', 'г') THEN 0.001 ELSE 1.000 END AS size,
    CASE regexp_extract(pack_info, '{PACK_RE}', 3, 'i') WHEN 'мл' THEN 'л' WHEN 'л' THEN 'л' WHEN 'г' THEN 'кг' WHEN 'бр' THEN 'бр' END AS unit
  FROM products WHERE pack_info IS NOT NULL)"""
_A, _B = "(CAST(price * 100 AS HUGEINT) * 1000000)", "CAST(size * 1000000 AS HUGEINT)"
#: price / size to cents, halves to even, in whole numbers.


def half_even(num: str, den: str, unit: int) -> str:
    """num / den, neither below zero, in whole ``unit`` parts, halves to even, as SQL in whole numbers."""
    return f"""CAST(({num} // {den} + CASE WHEN 2 * ({num} % {den}) > {den} OR (2 * ({num} % {den}) = {den} AND ({num} // {den}) % 2 = 1)
  THEN 1 ELSE 0 END) AS DECIMAL(18,0)) / {unit}"""


PPU = half_even(_A, _B, 100)
_CENTS = "CAST({} * 100 AS HUGEINT)"


def query(tables: str = "", sql: str = ""):
    """Register a function of (load) under its name, with SQL over the named adapters."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))
        if sql:
            head = with_tables(*tables.split())
            ORACLE[f.__name__] = head + ("" if sql.lstrip().startswith("SELECT") else ", ") + sql if tables else sql
        return f

    return put


@query("prices", f"{LATEST} SELECT product_id, store_id, price, recorded_at, load_key, load_line FROM latest")
def latest_prices(t):
    return P.latest_prices(t("prices")).select("product_id", "store_id", "price", "recorded_at", "load_key", "load_line")


@query("prices stores", f"{LATEST} SELECT product_id, store_id, store_name, price, load_key, load_line FROM latest JOIN stores USING (store_id)")
def product_store_prices(t):
    now = P.latest_prices(t("prices")).select("product_id", "store_id", "price", "load_key", "load_line")
    return now.join(t("stores").select("store_id", "store_name"), "store_id")


@query(
    "prices stores",
    f"""{LATEST} SELECT product_id, store_id, store_name, price, load_key, load_line,
    CASE WHEN low = 0 THEN 0 ELSE {half_even("(" + _CENTS.format("(price - low)") + " * 1000)", _CENTS.format("low"), 10)} END AS pct_above
    FROM (SELECT *, min(price) OVER (PARTITION BY product_id) AS low FROM latest) JOIN stores USING (store_id)""",
)
def compare_prices(t):
    out = P.compare(t("prices"), t("stores"), F.lit(True))
    return out.select("product_id", "store_id", "store_name", "price", "load_key", "load_line", "pct_above")


@query(
    "prices stores",
    f"""{LATEST} SELECT product_id, store_id, price, store_name FROM latest JOIN stores USING (store_id)
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id, load_key, load_line) = 1""",
)
def cheapest_store(t):
    return P.cheapest_store(t("prices"), t("stores")).select("product_id", "store_id", "price", "store_name")


@query(
    "prices products",
    f"""{LATEST} SELECT l.product_id, name, store_id, price, discount_percent, load_key, load_line
    FROM latest l JOIN products p ON l.product_id = p.product_id
    WHERE status = 'active' AND discount_percent > 0
    ORDER BY discount_percent DESC, load_key, load_line LIMIT 200""",
)
def best_deals(t):
    d = P.deals(t("prices"), t("products")).select("product_id", "name", "store_id", "price", "discount_percent", "load_key", "load_line")
    return d.orderBy(F.desc("discount_percent"), "load_key", "load_line").limit(200)


@query(
    "prices products",
    f"""{LATEST} SELECT top_category, count(*) AS n_deals, count(DISTINCT name) AS n_names
    FROM latest l JOIN products p ON l.product_id = p.product_id
    WHERE status = 'active' AND discount_percent > 0 GROUP BY top_category""",
)
def deals_total(t):
    d = P.deals(t("prices"), t("products"))
    return d.groupBy("top_category").agg(F.count("*").alias("n_deals"), F.countDistinct("name").alias("n_names"))


@query(
    "prices products",
    f"""{LATEST} SELECT DISTINCT top_category, category FROM latest l JOIN products p ON l.product_id = p.product_id
    WHERE status = 'active' AND discount_percent > 0""",
)
def deal_categories(t):
    return P.deals(t("prices"), t("products")).select("top_category", "category").distinct()


@query(
    "products prices",
    f"""{LATEST}, a AS (SELECT product_id, min(price) AS min_price, count(DISTINCT store_id) AS n_stores, max(recorded_at) AS updated_at
    FROM latest GROUP BY 1)
    SELECT p.product_id, name, min_price, coalesce(n_stores, 0) AS n_stores, updated_at FROM products p LEFT JOIN a USING (product_id)""",
)
def product_summary(t):
    return P.product_summary(t("products"), t("prices")).select("product_id", "name", "min_price", "n_stores", "updated_at")


@query(
    "products prices",
    f"""{LATEST} SELECT product_id, min(price) AS lowest, count(*) AS store_count, max(recorded_at) AS updated_at
    FROM latest GROUP BY product_id""",
)
def product_detail(t):
    return P.latest_prices(t("prices")).groupBy("product_id").agg(
        F.min("price").alias("lowest"), F.count("*").alias("store_count"), F.max("recorded_at").alias("updated_at")
    )


@query("products", "SELECT product_id, name, brand, pack_info FROM products WHERE status = 'active'")
def active_products(t):
    return t("products").where("status = 'active'").select("product_id", "name", "brand", "pack_info")


@query("products", "SELECT product_id, name FROM products WHERE name ILIKE '%blue%' OR brand ILIKE '%#1%'")
def name_substring(t):
    return t("products").where(F.col("name").ilike("%blue%") | F.col("brand").ilike("%#1%")).select("product_id", "name")


@query(
    "products prices",
    f"""{SIZED}, {LATEST} SELECT l.product_id, store_id, price, load_key, load_line, {PPU} AS unit_price, unit
    FROM latest l JOIN sized USING (product_id)""",
)
def unit_price(t):
    rows = P.latest_prices(t("prices")).join(t("products").where("pack_info is not null").select("product_id", "pack_info"), "product_id")
    return rows.select(
        "product_id", "store_id", "price", "load_key", "load_line",
        packs.unit_price(F.col("price"), F.col("pack_info")).alias("unit_price"), packs.pack_base(F.col("pack_info")).alias("unit"),
    )


FAMILIES = f"""{SIZED}, {LATEST}, r AS (
  SELECT p.name, p.product_id, p.brand, p.pack_info, store_id, price, recorded_at, unit, {PPU} AS ppu
  FROM products p LEFT JOIN latest USING (product_id) LEFT JOIN sized USING (product_id) WHERE status = 'active'),
f AS (SELECT name, count(DISTINCT nullif(lower(trim(brand)), '')) AS n_brands,
  count(DISTINCT lower(trim(pack_info))) AS n_packs, count(DISTINCT store_id) AS n_stores,
  count(DISTINCT product_id) AS n_products, min(price) AS min_price, min(ppu) AS min_unit_price,
  (arg_min(unit, (ppu, product_id)) FILTER (ppu IS NOT NULL)) AS unit, max(recorded_at) AS updated_at FROM r GROUP BY name)"""


@query("products prices", f"{FAMILIES} SELECT * FROM f")
def product_families(t):
    return P.families(t("products"), t("prices"))


@query(
    "products prices",
    f"""{FAMILIES} SELECT * FROM f WHERE name IN (SELECT name FROM products WHERE status = 'active' AND category_id = 3
    AND product_id IN (SELECT product_id FROM prices WHERE store_id = 5))""",
)
def families_filtered(t):
    sold = t("prices").where("store_id = 5").select("product_id").distinct()
    names = t("products").where("status = 'active' and category_id = 3").join(sold, "product_id", "left_semi")
    return P.families(t("products"), t("prices"), names)


@query("products prices", f"{FAMILIES} SELECT name, n_products, min_price FROM f ORDER BY name LIMIT 20 OFFSET 20")
def catalogue_page(t):
    f = P.families(t("products"), t("prices"))
    return f.select("name", "n_products", "min_price").orderBy("name").offset(20).limit(20)


@query(
    "products prices",
    f"""{LATEST} SELECT name, count(DISTINCT products.brand) AS n_brands, count(*) AS n_rows,
    coalesce(array_to_string(list_sort(list(DISTINCT products.brand)), '|'), '') AS brands
    FROM products JOIN latest l USING (product_id) WHERE status = 'active' GROUP BY name""",
)
def family_header(t):
    rows = P.latest_prices(t("prices")).drop("brand").join(t("products").where("status = 'active'"), "product_id")
    return rows.groupBy("name").agg(
        F.countDistinct("brand").alias("n_brands"), F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("brand")), "|").alias("brands")
    )


BROWSE = f"""{LATEST}, b AS (SELECT l.top_category, l.category, coalesce(product_type, 'Общо') AS product_type,
  coalesce(l.brand, 'Собствена марка') AS brand, min(price) AS min_price, max(price) AS max_price,
  max(discount_percent) AS max_discount, count(DISTINCT store_id) AS n_stores
  FROM latest l JOIN products p ON l.product_id = p.product_id
  WHERE status = 'active' AND top_category IS NOT NULL GROUP BY ALL)"""


@query("products prices", f"{BROWSE} SELECT * FROM b")
def browse_brands(t):
    return P.browse_brands(t("prices"), t("products"))


@query(
    "products prices",
    f"""{BROWSE} SELECT top_category, category, product_type, min(min_price) AS min_price, max(max_price) AS max_price,
    CAST(grouping(top_category, category, product_type) AS INTEGER) AS level
    FROM b GROUP BY ROLLUP (top_category, category, product_type) HAVING grouping(top_category, category, product_type) < 7""",
)
def browse_rollup(t):
    return P.browse_rollup(P.browse_brands(t("prices"), t("products")))


@query(
    "prices",
    f"""SELECT product_id, store_id, CAST(min(recorded_at) AS DATE) AS first_date, count(*) AS n,
    {half_even(_CENTS.format("sum(price)"), "count(*)", 100)} AS avg_price
    FROM prices GROUP BY product_id, store_id, date_trunc('week', recorded_at)""",
)
def history_weekly(t):
    return P.weekly(t("prices"))


@query(
    "prices",
    """SELECT product_id, store_id, count(*) AS n,
    array_to_string(list(strftime(recorded_at, '%Y-%m-%d') || '=' || CAST(price AS VARCHAR) ORDER BY recorded_at, price), ',') AS series
    FROM prices GROUP BY product_id, store_id""",
)
def history_daily(t):
    point = F.struct("recorded_at", "price")
    series = F.transform(F.array_sort(F.collect_list(point)), lambda x: F.concat_ws("=", F.date_format(x["recorded_at"], "yyyy-MM-dd"), x["price"].cast("string")))
    return t("prices").groupBy("product_id", "store_id").agg(F.count("*").alias("n"), F.array_join(series, ",").alias("series"))


@query(
    "prices",
    """SELECT product_id, store_id, price, recorded_at, load_key, load_line FROM prices
    WHERE recorded_at >= TIMESTAMP '1995-03-01' AND recorded_at < TIMESTAMP '1995-04-01'""",
)
def history_range(t):
    rows = t("prices").where("recorded_at >= timestamp_ntz'1995-03-01' and recorded_at < timestamp_ntz'1995-04-01'")
    return rows.select("product_id", "store_id", "price", "recorded_at", "load_key", "load_line")


@query(
    "prices",
    """SELECT CAST(recorded_at AS DATE) AS day, min(price) FILTER (store_id = 1) AS s1, min(price) FILTER (store_id = 2) AS s2,
    min(price) FILTER (store_id = 3) AS s3 FROM prices WHERE store_id IN (1, 2, 3) GROUP BY 1""",
)
def history_pivot(t):
    rows = t("prices").where("store_id in (1, 2, 3)").withColumn("day", F.to_date("recorded_at"))
    return rows.groupBy("day").pivot("store_id", [1, 2, 3]).agg(F.min("price")).withColumnsRenamed({"1": "s1", "2": "s2", "3": "s3"})


@query(
    "prices",
    """r AS (SELECT * FROM prices WHERE recorded_at >= (SELECT max(recorded_at) FROM prices) - INTERVAL 365 DAY),
    a AS (SELECT product_id, arg_min(price, (recorded_at, load_key, load_line)) AS first_price,
    arg_max(price, (recorded_at, load_key, load_line)) AS last_price, count(*) AS n FROM r GROUP BY 1)
    SELECT *, CASE WHEN last_price * 100 > first_price * 101 THEN 'up' WHEN last_price * 100 < first_price * 99 THEN 'down' ELSE 'stable' END AS trend
    FROM a WHERE n >= 2""",
)
def price_trend(t):
    return P.trend(t("prices"), 365)


@query(
    "prices",
    """SELECT product_id, store_id, recorded_at, price, load_key, load_line FROM prices
    QUALIFY row_number() OVER (PARTITION BY product_id, store_id, recorded_at ORDER BY load_key DESC, load_line DESC) = 1""",
)
def dedup_prices(t):
    return P.dedup_prices(t("prices")).select("product_id", "store_id", "recorded_at", "price", "load_key", "load_line")


@query(
    "prices",
    """SELECT product_id, brand, count(*) AS n FROM prices WHERE brand IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, brand) = 1""",
)
def modal_brand(t):
    return P.modal_brand(t("prices"))


TREE = """tree AS (SELECT id, name, parent_id, 0 AS depth, name AS path FROM categories WHERE parent_id IS NULL
  UNION ALL SELECT c.id, c.name, c.parent_id, depth + 1, path || ' > ' || c.name FROM categories c JOIN tree t ON c.parent_id = t.id)"""


@query("categories", f"{TREE} SELECT * FROM tree")
def category_tree(t):
    return T.category_tree(t("categories"))


@query(
    "categories products",
    """sub AS (SELECT id FROM categories WHERE id = 102 UNION ALL SELECT c.id FROM categories c JOIN sub s ON c.parent_id = s.id)
    SELECT product_id, name, category_id FROM products WHERE category_id IN (SELECT id FROM sub)""",
)
def subtree_products(t):
    ids = T.in_subtree(t("categories"), 102).select(F.col("id").alias("category_id"))
    return t("products").join(ids, "category_id", "left_semi").select("product_id", "name", "category_id")


RUNS = """last AS (SELECT * FROM scrape_runs QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY started_at DESC, run_id DESC) = 1),
  st AS (SELECT s.store_id, store_name, run_id, coalesce(status, 'idle') AS status, items_found
  FROM stores s LEFT JOIN last USING (store_id) WHERE active)"""


def _status(t):
    return T.run_status(t("stores"), t("scrape_runs")).select("store_id", "store_name", "run_id", "status", "items_found")


@query("stores scrape_runs", f"{RUNS} SELECT * FROM st")
def run_status(t):
    return _status(t)


@query("stores scrape_runs", f"{RUNS} SELECT * FROM st WHERE status = 'failed' OR (status = 'completed' AND items_found = 0)")
def run_alerts(t):
    return T.run_alerts(_status(t))


@query("stores scrape_runs", f"{RUNS} SELECT store_id, store_name, run_id FROM st WHERE status = 'running'")
def running_stores(t):
    return _status(t).where("status = 'running'").select("store_id", "store_name", "run_id")


@query(
    "scrape_runs",
    """beat AS (SELECT store_id, max(started_at) AS beat FROM scrape_runs WHERE status <> 'running' GROUP BY 1)
    SELECT run_id, r.store_id, CASE WHEN status = 'running' AND coalesce(beat < (SELECT max(started_at) FROM scrape_runs) - INTERVAL 1800 SECOND, true)
    THEN 'failed' ELSE status END AS status FROM scrape_runs r LEFT JOIN beat USING (store_id)""",
)
def reap_stale_runs(t):
    runs = t("scrape_runs")
    now = runs.agg(F.max("started_at").alias("now"))  # one row
    beats = runs.where("status <> 'running'").select("store_id", F.col("started_at").alias("ts"))
    out = T.reap_stale(runs.join(F.broadcast(now), F.lit(True)), beats, F.col("now"))
    return out.select("run_id", "store_id", "status")


@query(
    "stores brochures",
    """n AS (SELECT * FROM brochures WHERE is_current QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY valid_from DESC NULLS FIRST, brochure_id DESC) = 1)
    SELECT s.store_id, store_name, brochure_id, valid_from FROM stores s LEFT JOIN n USING (store_id)""",
)
def store_brochures(t):
    return T.store_brochures(t("stores"), t("brochures")).select("store_id", "store_name", "brochure_id", "valid_from")


@query("brochures", "SELECT brochure_id, store_id, valid_from FROM brochures WHERE is_current")
def active_brochures(t):
    return t("brochures").where("is_current").select("brochure_id", "store_id", "valid_from")


BATCH = "recorded_at >= TIMESTAMP '1998-01-01'"
GUARD = f"""b AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id, brand, CAST(recorded_at AS DATE) ORDER BY load_key, load_line) AS nth
  FROM prices WHERE {BATCH} OR load_line = 1),
  g AS (SELECT b.product_id, b.store_id, b.load_key, b.load_line, b.nth > 1 OR EXISTS (SELECT 1 FROM prices h WHERE NOT ({BATCH.replace("recorded_at", "h.recorded_at")})
  AND h.product_id = b.product_id AND h.store_id = b.store_id AND h.brand IS NOT DISTINCT FROM b.brand
  AND CAST(h.recorded_at AS DATE) = CAST(b.recorded_at AS DATE)) AS skip FROM b)"""


def _guarded(t):
    prices = t("prices")
    new = F.col("recorded_at") >= F.expr("timestamp_ntz'1998-01-01'")
    return T.guarded(prices.where(new | (F.col("load_line") == 1)), prices.where(~new))


@query("prices", f"{GUARD} SELECT product_id, store_id, load_key, load_line, CASE WHEN skip THEN 'skipped' ELSE 'inserted' END AS outcome FROM g")
def ingest_prices(t):
    return _guarded(t).select("product_id", "store_id", "load_key", "load_line", "outcome")


@query("prices", f"{GUARD} SELECT CASE WHEN skip THEN 'skipped' ELSE 'inserted' END AS outcome, count(*) AS n FROM g GROUP BY 1")
def ingest_stats(t):
    return _guarded(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query("products", "SELECT product_id, name, CASE WHEN product_id % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM products")
def idempotent_insert(t):
    rows = t("products").select("product_id", "name")
    have = rows.where("product_id % 3 <> 0").withColumn("origin", F.lit("old"))
    return T.insert_missing(have, rows.withColumn("origin", F.lit("new")), "product_id")


@query(
    "products prices",
    """f AS (SELECT product_id, arg_min(brand, (load_key, load_line)) AS nb FROM prices WHERE brand IS NOT NULL GROUP BY 1)
    SELECT product_id, name, coalesce(CASE WHEN product_id % 2 = 0 THEN brand END, nb) AS brand FROM products LEFT JOIN f USING (product_id)""",
)
def enrich_products(t):
    bare = t("products").select("product_id", "name", F.when(F.col("product_id") % 2 == 0, F.col("brand")).alias("brand"))
    return T.enrich(bare, t("prices"), "brand")


@query(
    "products prices",
    """k AS (SELECT product_id, category FROM prices WHERE category IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, load_key DESC, load_line DESC) = 1)
    SELECT p.product_id, name, category FROM products p LEFT JOIN k USING (product_id)""",
)
def backfill_category(t):
    return T.backfill_category(t("products"), t("prices")).select("product_id", "name", "category")


@query(
    "products",
    """SELECT product_id, name, CASE WHEN product_id % 20 = 0 THEN 'active' ELSE status END AS status FROM products
    WHERE NOT (product_id % 30 = 10 AND status = 'pending_review')""",
)
def apply_moderation(t):
    p = t("products")
    actions = p.select("product_id", F.when(F.col("product_id") % 20 == 0, "approve").when(F.col("product_id") % 30 == 10, "reject").alias("action")).where(
        "action is not null"
    )
    both = actions.where("not (product_id % 20 = 0 and product_id % 30 = 10)")
    return T.moderate(p, both.unionByName(p.where("product_id % 20 = 0 and product_id % 30 = 10").select("product_id", F.lit("reject").alias("action")))).select(
        "product_id", "name", "status"
    )


@query(
    "products",
    """SELECT product_id, CASE WHEN product_id % 7 = 0 THEN upper(name) ELSE name END AS name,
    CASE WHEN product_id % 14 = 0 THEN 'X' ELSE brand END AS brand FROM products""",
)
def apply_updates(t):
    p = t("products").select("product_id", "name", "brand")
    u = p.where("product_id % 7 = 0").select("product_id", F.upper("name").alias("name"), F.when(F.col("product_id") % 14 == 0, "X").alias("brand"))
    return T.update_partial(p, u, ["name", "brand"])


@query("products prices", "SELECT product_id, count(*) AS n, sum(price) AS total FROM prices WHERE product_id % 11 <> 0 GROUP BY product_id")
def delete_cascade(t):
    _, left = T.delete_cascade(t("products"), t("prices"), t("products").where("product_id % 11 = 0"))
    return left.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("products", "SELECT 2 * product_id AS product_id, 2 * product_id IN (SELECT product_id FROM products) AS found FROM products")
def batch_delete(t):
    p = t("products").select("product_id")
    asked = p.select((F.col("product_id") * 2).alias("product_id"))
    return asked.join(p, "product_id", "left_semi").withColumn("found", F.lit(True)).unionByName(
        asked.join(p, "product_id", "left_anti").withColumn("found", F.lit(False))
    )


MERGED = "m AS (SELECT product_id, min(product_id) OVER (PARTITION BY name, brand, pack_info) AS kept_id FROM products)"


@query(
    "products prices",
    f"""{MERGED} SELECT coalesce(kept_id, p.product_id) AS product_id, count(*) AS n, sum(price) AS total
    FROM prices p JOIN m USING (product_id) GROUP BY 1""",
)
def merge_products(t):
    w = Window.partitionBy("name", "brand", "pack_info")
    m = t("products").select("product_id", F.min("product_id").over(w).alias("kept_id")).where("product_id <> kept_id")
    _, moved = T.merge_products(t("products"), t("prices"), m)
    return moved.groupBy("product_id").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query(
    "products",
    """SELECT product_id, name, brand FROM products WHERE status = 'active'
    AND list_contains(string_split_regex(lower(concat_ws(' ', name, brand)), '[^a-z0-9]+'), 'blue')
    AND list_contains(string_split_regex(lower(concat_ws(' ', name, brand)), '[^a-z0-9]+'), 'brand')""",
)
def search_products(t):
    return T.search(t("products"), "blue brand").select("product_id", "name", "brand")


def _lines(t):
    parts = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return t("documents").where("text is not null").select(F.col("doc_id").alias("page_id"), parts)


LINES = """l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS line,
  CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents WHERE text IS NOT NULL)"""


@query(
    "",
    f"WITH {LINES} SELECT page_id, line_no, line FROM l QUALIFY row_number() OVER (PARTITION BY page_id, lower(trim(line)) ORDER BY line_no) = 1",
)
def page_dedup(t):
    return T.page_dedup(_lines(t)).select("page_id", "line_no", "line")


@query(
    "",
    f"""WITH {LINES} SELECT page_id, line_no, trim(regexp_replace(regexp_replace(lower(strip_accents(line)), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name,
    trim(regexp_replace(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM l""",
)
def normalise_names(t):
    line = F.col("line")
    return _lines(t).select("page_id", "line_no", text.normalise_name(line).alias("name"), text.normalise_title(line).alias("title"))


@query("products", "SELECT product_id, regexp_replace(trim(regexp_replace(lower(trim(pack_info)), '(\\d),(\\d)', '\\1.\\2', 'g')), '\\s+', ' ', 'g') AS pack FROM products")
def normalise_packs(t):
    return t("products").select("product_id", text.normalise_pack(F.col("pack_info")).alias("pack"))


@query(
    "prices",
    """SELECT load_key, load_line, 'EUR' AS currency, CASE WHEN source = 'brochure' THEN 'brochure' ELSE 'web' END AS source FROM prices""",
)
def price_codes(t):
    odd = F.when(F.col("load_line") % 3 == 0, "bgn").when(F.col("load_line") % 3 == 1, "лв").otherwise("")
    return t("prices").select(
        "load_key", "load_line", text.currency_code(odd).alias("currency"), text.source_code(F.col("source")).alias("source")
    )


@query("", "SELECT page_id, regexp_replace(url, 'w=[0-9]+', 'w=400', 'g') AS image, url LIKE 'https%' AS secure FROM pages")
def page_links(t):
    return t("pages").select("page_id", text.larger_image(F.col("url")).alias("image"), F.col("url").startswith("https").alias("secure"))


@query()
def name_slugs(t):
    """Rows only: slugs of all product names, with a Cyrillic part."""
    c: Column = F.concat_ws(" ", "name", "pack_info")
    return t("products").select("product_id", text.name_slug(c).alias("slug"))


@query()
def brochure_prices(t):
    """Rows only: document lines that hold a price."""
    return _lines(t).withColumn("price", packs.first_price(F.col("line"))).where("price is not null")


@query()
def dup_candidates(t):
    """Rows only: similar product names, by the blocked join."""
    from ..operators.resolve import similar_names

    return similar_names(t("products").select("name"))


@query(
    "products",
    """c AS (SELECT name, count(*) AS n FROM products GROUP BY name)
    SELECT product_id, name, n - 1 AS same_name FROM products JOIN c USING (name)""",
)
def same_names(t):
    """Products of an equal normalised name, the surest duplicates."""
    from ..operators.resolve import duplicate_products

    return duplicate_products(t("products"), 100.0).withColumnRenamed("n_links", "same_name")


@query()
def dup_products(t):
    """Rows only: the number of likely duplicates of every product."""
    from ..operators.resolve import duplicate_products

    return duplicate_products(t("products"))


@query(
    "prices products",
    """p AS (SELECT CASE WHEN product_id % 9 = 0 THEN '' ELSE lpad(CAST(product_id // 2 AS VARCHAR), 13, '0') END AS barcode, product_id FROM products),
    f AS (SELECT barcode, min(product_id) AS product_id FROM p WHERE barcode <> '' GROUP BY 1)
    SELECT load_key, load_line, f.product_id FROM prices LEFT JOIN f ON f.barcode = lpad(CAST(prices.product_id // 2 AS VARCHAR), 13, '0')""",
)
def match_barcode(t):
    """Every price row as an item with a barcode; two products share one, some have none."""
    from ..operators.resolve import match_barcode as match

    code = F.lpad(F.expr("product_id div 2").cast("string"), 13, "0")
    p = t("products").select("product_id", F.when(F.col("product_id") % 9 == 0, "").otherwise(code).alias("barcode"))
    items = t("prices").select(F.struct("load_key", "load_line").alias("item_no"), code.alias("barcode"))
    return match(items, p).select("item_no.load_key", "item_no.load_line", "product_id")


@query("products", "SELECT product_id, name, brand FROM products WHERE status = 'active' AND (name ILIKE '%lue bol%' OR brand ILIKE '%lue bol%')")
def search_fallback(t):
    return T.search_or_part(t("products"), "lue bol").select("product_id", "name", "brand")


@query()
def match_sku(t):
    """Rows only: every product, an s after its name, as an item against all products."""
    from ..operators.resolve import match_sku as match

    p = t("products")
    items = p.select(F.col("product_id").alias("item_no"), F.concat(F.col("name"), F.lit("s")).alias("name"), "brand", "pack_info")
    return match(items, p)


@query()
def match_catalog(t):
    """Rows only: titles of pages against a catalog of product names."""
    from ..operators.resolve import match_catalog as match

    catalog = t("products").groupBy("name").agg(F.min("product_id").alias("ordinal"))
    titles = t("products").select(F.concat_ws(" ", "brand", "name", "pack_info").alias("title"))
    return match(titles, catalog)


ORACLE["stream_weekly"] = """SELECT CAST(user_id % 80 AS BIGINT) AS store_id, CAST(date_trunc('week', ts) AS DATE) AS week,
    round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2"""
ORACLE["stream_ingest"] = "SELECT DISTINCT CAST(user_id % 80 AS BIGINT) AS store_id, event_type, CAST(ts AS DATE) AS day FROM events"


def _stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    return jobs.weekly_means(jobs.runs_stream(spark, sf_dir)).withColumn("store_id", F.col("store_id").cast("long"))


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    out = jobs.guarded_ingest(jobs.runs_stream(spark, sf_dir))
    return out.select(F.col("store_id").cast("long").alias("store_id"), "event_type", "day")


ORACLE["stream_closed_weeks"] = ORACLE["stream_weekly"] + """
    HAVING CAST(date_trunc('week', any_value(ts)) AS TIMESTAMP) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""
ORACLE["stream_silent"] = """WITH b AS (SELECT DISTINCT CAST(user_id % 80 AS BIGINT) AS store_id, ts FROM events WHERE event_type <> 'view'),
    n AS (SELECT *, lead(ts) OVER (PARTITION BY store_id ORDER BY ts) AS after FROM b)
    SELECT store_id, ts AS beat, ts + INTERVAL 1800 SECOND AS silent_at FROM n
    WHERE (after IS NULL OR after > ts + INTERVAL 1800 SECOND) AND ts + INTERVAL 1800 SECOND <= date_trunc('milliseconds', (SELECT max(ts) FROM b)) - INTERVAL 2 DAY"""


def _stream_closed_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    return jobs.closed_weeks(jobs.runs_stream(spark, sf_dir)).withColumn("store_id", F.col("store_id").cast("long"))


def _stream_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    out = jobs.silent_stores(jobs.runs_stream(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("beat", "silent_at")})


QUERIES |= {"stream_weekly": _stream_weekly, "stream_ingest": _stream_ingest, "stream_closed_weeks": _stream_closed_weeks, "stream_silent": _stream_silent}


@query("products", "SELECT product_id, name, brand FROM products WHERE product_id = 42")
def product_lookup(t):
    return t("products").where("product_id = 42").select("product_id", "name", "brand")


@query("products", "SELECT product_id, name FROM products WHERE product_id IN (1, 5, 9, 1000000)")
def product_subset(t):
    return t("products").where(F.col("product_id").isin(1, 5, 9, 1_000_000)).select("product_id", "name")


@query("stores", "SELECT store_id, store_slug FROM stores WHERE active AND store_slug LIKE '%7%'")
def stores_due(t):
    return t("stores").where(F.col("active") & F.col("store_slug").contains("7")).select("store_id", "store_slug")


@query(
    "scrape_runs",
    """SELECT run_id, store_id, started_at, coalesce(CASE WHEN status = 'failed' THEN 'ERROR' END, 'INFO') AS level
    FROM scrape_runs ORDER BY started_at DESC, run_id DESC LIMIT 200""",
)
def recent_logs(t):
    level = F.coalesce(F.when(F.col("status") == "failed", "ERROR"), F.lit("INFO")).alias("level")
    return t("scrape_runs").select("run_id", "store_id", "started_at", level).orderBy(F.desc("started_at"), F.desc("run_id")).limit(200)


@query(
    "products prices stores",
    """n AS (SELECT product_id, array_to_string(list_sort(list(DISTINCT store_name)), '|') AS stores FROM prices JOIN stores USING (store_id) GROUP BY 1),
    l AS (SELECT product_id, price AS last_price FROM prices QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY recorded_at DESC, load_key DESC, load_line DESC) = 1)
    SELECT p.product_id, name, stores, last_price FROM products p LEFT JOIN n USING (product_id) LEFT JOIN l USING (product_id)
    WHERE status = 'pending_review'""",
)
def review_queue(t):
    return T.review_queue(t("products"), t("prices"), t("stores")).select("product_id", "name", "stores", "last_price")


@query(
    "products prices",
    f"""{LATEST} SELECT product_id, store_id, price, load_key, load_line, products.brand AS brand, pack_info
    FROM products JOIN latest USING (product_id) WHERE status = 'active' AND name = 'blue bolt'""",
)
def family_variants(t):
    return P.family_variants(t("products"), t("prices"), "blue bolt").drop("unit_price")


@query(
    "products prices stores",
    f"""{LATEST}, h AS (SELECT product_id, name FROM products WHERE status = 'active' AND name ILIKE '%blue%' ORDER BY name, product_id LIMIT 5)
    SELECT h.product_id, name, store_id, price, count(*) OVER (PARTITION BY h.product_id) AS n_stores FROM h JOIN latest USING (product_id)
    QUALIFY row_number() OVER (PARTITION BY h.product_id ORDER BY price, store_id, load_key, load_line) = 1""",
)
def search_compare(t):
    hits = T.search(t("products"), "blue").select("product_id", "name").orderBy("name", "product_id").limit(5)
    own = P.latest_prices(t("prices").join(F.broadcast(hits), "product_id"))  # five rows
    n = own.groupBy("product_id").agg(F.count("*").alias("n_stores"))
    best = P.cheapest_store(t("prices").join(F.broadcast(hits), "product_id"), t("stores")).select("product_id", "store_id", "price")
    return best.join(n, "product_id").join(F.broadcast(hits), "product_id").select("product_id", "name", "store_id", "price", "n_stores")


@query(
    "products",
    """SELECT lower(trim(name)) AS name, lower(brand) AS brand, pack_info, count(*) AS n_items, min(product_id) AS first_item FROM products
    GROUP BY 1, 2, 3""",
)
def new_products(t):
    items = t("products").withColumnRenamed("product_id", "item_no")
    out = T.new_products(items, text.normalise_name(F.col("name")), text.brand_key(F.col("brand")), text.normalise_pack(F.col("pack_info")))
    return out.select("name", "brand", "pack_info", "n_items", "first_item")


@query(
    "products prices",
    """m AS (SELECT product_id, brand AS mb FROM prices WHERE brand IS NOT NULL GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, brand) = 1)
    SELECT product_id, coalesce(CASE WHEN product_id % 4 <> 0 THEN brand END, mb) AS brand FROM products LEFT JOIN m USING (product_id)""",
)
def backfill_brand(t):
    bare = t("products").select("product_id", F.when(F.col("product_id") % 4 != 0, F.col("brand")).alias("brand"))
    modal = P.modal_brand(t("prices")).select("product_id", F.col("brand").alias("modal"))
    return bare.join(modal, "product_id", "left").select("product_id", F.coalesce("brand", "modal").alias("brand"))


@query(
    "",
    """WITH p AS (SELECT user_id AS seq_id, event_id AS page_no, event_type AS content FROM events),
    a AS (SELECT *, coalesce(content <> lag(content) OVER w, true) AS new FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY page_no)),
    b AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY seq_id ORDER BY page_no) AS run FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY seq_id, run ORDER BY page_no) - 1 AS place FROM b)
    SELECT seq_id, page_no, content FROM c QUALIFY new AND max(place) OVER (PARTITION BY seq_id ORDER BY page_no) < 3""",
)
def page_runs(t):
    e = t("events").select(F.col("user_id").alias("seq_id"), F.col("event_id").alias("page_no"), F.col("event_type").alias("content"))
    return T.page_runs(e)


@query(
    "",
    """SELECT page_id, CASE WHEN split_part(lower(url), '?', 1) LIKE '%.pdf' THEN 'pdf'
    WHEN regexp_matches(split_part(lower(url), '?', 1), '(/viewer/|/ar/[0-9]+|flipbook|publitas|issuu)') THEN 'viewer' ELSE 'page' END AS kind FROM pages""",
)
def classify_links(t):
    return t("pages").select("page_id", dates.link_kind(F.col("url")).alias("kind"))


@query(
    "prices",
    """SELECT store_id, source, count(*) AS n FROM (SELECT store_id, 'web' AS source FROM prices WHERE source = 'web'
    UNION ALL SELECT store_id, 'brochure' FROM prices WHERE source = 'brochure') GROUP BY 1, 2""",
)
def union_offers(t):
    p = t("prices")
    web, flyer = p.where("source = 'web'").select("store_id", "source", "brand"), p.where("source = 'brochure'").select("store_id", "source")
    return web.unionByName(flyer, allowMissingColumns=True).groupBy("store_id", "source").agg(F.count("*").alias("n"))


@query()
def brochure_offers(t):
    """Rows only: priced lines of documents with the lines above them."""
    return T.priced_blocks(_lines(t), packs.first_price(F.col("line"))).withColumn("price", F.col("price").cast("double"))


@query()
def date_ranges(t):
    """Rows only: validity ranges in document lines."""
    return _lines(t).select("page_id", "line_no", dates.date_range(F.col("line"), 2026).alias("r")).select("page_id", "line_no", "r.*").where("valid_from is not null")


@query()
def price_sanity(t):
    """Rows only: prices per kilogram against a ceiling."""
    rows = P.latest_prices(t("prices")).join(t("products").select("product_id", "pack_info"), "product_id")
    return rows.select(
        "load_key", "load_line", packs.euro_per_kilo(F.col("price"), F.col("pack_info")).alias("per_kilo"),
        packs.plausible(F.col("price"), F.col("pack_info"), F.lit("Плодове")).alias("plausible"),
    )



@query(
    "",
    """WITH RECURSIVE c AS (SELECT c_custkey AS id, c_name AS name, nullif(c_custkey // 4, 0) AS parent_id FROM customer),
    w AS (SELECT id, name, parent_id, 0 AS depth, [{'name': name, 'id': id}] AS way FROM c WHERE parent_id IS NULL
      UNION ALL SELECT c.id, c.name, c.parent_id, depth + 1, list_append(way, {'name': c.name, 'id': c.id}) FROM c JOIN w ON c.parent_id = w.id),
    sizes AS (SELECT id, count(*) AS size FROM (SELECT unnest(list_transform(way, lambda x: x.id)) AS id FROM w) GROUP BY id)
    SELECT id, name, parent_id, depth, row_number() OVER (ORDER BY way) - 1 AS pre, row_number() OVER (ORDER BY way) - 2 + size AS last FROM w JOIN sizes USING (id)""",
)
def category_order(t):
    """A tree of all customers, each under the fourth of its number: pre-order and the range of each subtree."""
    tree = t("customer").selectExpr("c_custkey AS id", "c_name AS name", "nullif(c_custkey div 4, 0) AS parent_id")
    return O.tree_intervals(tree)


@query(
    "categories products",
    """sub AS (SELECT id FROM categories WHERE id = 102 UNION ALL SELECT c.id FROM categories c JOIN sub s ON c.parent_id = s.id)
    SELECT product_id, name, category_id FROM products WHERE category_id IN (SELECT id FROM sub)""",
)
def subtree_range(t):
    ids = O.subtree(O.tree_intervals(t("categories")), 102).select(F.col("id").alias("category_id"))
    return t("products").join(ids, "category_id", "left_semi").select("product_id", "name", "category_id")


@query(
    "prices",
    """SELECT product_id, store_id, nth, recorded_at, price, dense_rank() OVER (PARTITION BY product_id ORDER BY since, store_id) AS store_place FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY recorded_at, price, load_key, load_line) AS nth,
    min(recorded_at) OVER (PARTITION BY product_id, store_id) AS since FROM prices)""",
)
def history_series(t):
    """Every observation with its place in its store's series, stores in order of their first one."""
    own = t("prices").select("product_id", "store_id", "recorded_at", "price", "load_key", "load_line")
    rows = O.numbered(own, ["product_id", "store_id"], ["recorded_at", "price", "load_key", "load_line"]).drop("load_key", "load_line")
    first = P.by_product(own, "store_id", "recorded_at").groupBy("product_id", "store_id").agg(F.min("recorded_at").alias("since"))
    place = F.row_number().over(Window.partitionBy("product_id").orderBy("since", "store_id")).cast("long")
    stores = first.withColumn("store_place", place).drop("since")
    return rows.join(stores, ["product_id", "store_id"]).select("product_id", "store_id", "nth", "recorded_at", "price", "store_place")


PAGES = [("first", 0, 20), ("inner", 27, 20), ("last", 50, 100), ("past", 100_000_000, 20)]


@query(
    "products prices",
    f"""{FAMILIES}, ranked AS (SELECT name, n_products, min_price, row_number() OVER (ORDER BY name) - 1 AS place, count(*) OVER () AS total FROM f),
    pages AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {o}, {n})" for p, o, n in PAGES)}) v(page, begin, size))
    SELECT page, name, n_products, min_price, (SELECT count(*) FROM f) AS total FROM pages LEFT JOIN ranked ON place >= begin AND place < begin + size""",
)
def catalogue_total(t):
    """Pages of families with the total; a page past the end is its total alone."""
    index = O.RankIndex(P.families(t("products"), t("prices")).select("name", "n_products", "min_price"), "name")
    pages = [index.page(o, n).withColumn("page", F.lit(p)) for p, o, n in PAGES]
    rows = reduce(DataFrame.unionByName, pages)
    empty = index.rows.agg(F.count("*").alias("total")).select(F.explode(F.array(*[F.lit(p) for p, _, _ in PAGES])).alias("page"), "total")
    return empty.join(rows.drop("total"), "page", "left").select("page", "name", "n_products", "min_price", "total")


@query(
    "prices",
    """SELECT product_id, store_id, load_key, load_line, price, CASE WHEN recorded_at < TIMESTAMP '1998-01-01' THEN 'history' ELSE 'batch-1998' END AS batch,
    CAST(date_trunc('month', recorded_at) AS DATE) AS part FROM prices""",
)
def append_prices(t):
    """Two batches; the second one is begun and left, appended, and appended again."""
    rows = t("prices").select("product_id", "store_id", "load_key", "load_line", "price", "recorded_at")
    new = F.col("recorded_at") >= F.expr("timestamp_ntz'1998-01-01'")
    spark, path = rows.sparkSession, folder(rows.sparkSession, "facts")
    facts.append_batch(rows.where(~new), path, "history", every="month")
    facts.write_attempt(rows.where(new), path, "batch-1998", every="month")
    for _ in range(2):
        facts.append_batch(rows.where(new), path, "batch-1998", every="month")
    return facts.read_facts(spark, path, rows.schema).select("product_id", "store_id", "load_key", "load_line", "price", "batch", "part")


@query(
    "products",
    """g AS (SELECT *, (product_id + 4) // 5 AS grp FROM products),
    k AS (SELECT *, first_value(product_id) OVER (PARTITION BY grp ORDER BY created_on, product_id) AS kept, min(product_id) OVER (PARTITION BY grp) AS low,
      count(*) OVER (PARTITION BY grp) AS n FROM g)
    SELECT product_id, CASE WHEN n > 1 THEN 'N' || low ELSE name END AS name, CASE WHEN n = 1 THEN brand END AS brand FROM k WHERE product_id = kept""",
)
def merge_chains(t):
    """Groups of five products that decisions link one after the other, and the last with the first; the earliest one stays."""
    ids = t("products").select("product_id")
    onward = ids.where("product_id % 5 <> 0").selectExpr("product_id AS id_a", "product_id + 1 AS id_b")
    back = ids.where("product_id % 5 = 0").selectExpr("product_id AS id_a", "product_id - 4 AS id_b")
    itself = ids.selectExpr("product_id AS id_a", "product_id AS id_b")
    decisions = onward.unionByName(back).unionByName(itself).withColumns({"merge": F.lit(True), "canonical_name": F.concat(F.lit("N"), F.least("id_a", "id_b"))})
    left, _ = chains.merge_duplicates(t("products"), t("prices"), decisions, "created_on")
    return left.select("product_id", "name", "brand")


@query()
def merge_similar(t):
    """Rows only: products after the merge of similar names whose first words agree."""
    p = t("products")
    asked = chains.merge_candidates(p, "created_on")
    word = lambda c: F.split_part(F.lower(c), F.lit(" "), F.lit(1))
    decisions = asked.select("id_a", "id_b", (word("name_a") == word("name_b")).alias("merge"), F.col("name_a").alias("canonical_name"))
    left, _ = chains.merge_duplicates(p, t("prices"), decisions, "created_on")
    return left.select("product_id", "name", "brand")


#: Exact decimal columns, which both sides hand over as doubles.
DECIMALS = {
    "latest_prices": "price", "product_store_prices": "price", "compare_prices": "price pct_above", "cheapest_store": "price",
    "best_deals": "price", "product_summary": "min_price", "product_detail": "lowest", "unit_price": "price unit_price",
    "product_families": "min_price min_unit_price", "families_filtered": "min_price min_unit_price", "catalogue_page": "min_price",
    "browse_brands": "min_price max_price", "browse_rollup": "min_price max_price", "history_weekly": "avg_price",
    "history_range": "price", "history_pivot": "s1 s2 s3", "price_trend": "first_price last_price", "dedup_prices": "price",
    "delete_cascade": "total", "merge_products": "total", "brochure_prices": "price",
    "append_prices": "price", "history_series": "price", "catalogue_total": "min_price",
    "review_queue": "last_price", "family_variants": "price", "search_compare": "price",
}


def _doubles(run, names: list[str]):
    return lambda spark, sf_dir: run(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in names})


for _name, _columns in DECIMALS.items():
    QUERIES[_name] = _doubles(QUERIES[_name], _columns.split())
    if _name in ORACLE:
        _cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _columns.split())
        ORACLE[_name] = f"SELECT * REPLACE ({_cast}) FROM ({ORACLE[_name]})"
