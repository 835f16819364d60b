"""Registered queries over listings, responses, names, categories and the whole jobs. Their inputs are written out of the
price tables by SELECTs that Spark and DuckDB read alike, so that every row has a known right answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listing as L
from ..functions import names, text
from ..operators import chains
from ..operators.prices import PARTS
from ..sources import catalog, facts, offers
from ..sources.shared import folder
from . import queries as Q
from .queries import LATEST, query


@query("products", "SELECT product_id, CASE WHEN product_id % 4 IN (0, 1) THEN false ELSE true END AS good FROM products")
def name_quality(t):
    name = F.expr("CASE product_id % 4 WHEN 0 THEN 'Български' WHEN 1 THEN ' я ' ELSE name END")
    return t("products").select("product_id", names.is_product_name(name).alias("good"))


@query(
    "products",
    """SELECT product_id, CASE WHEN product_id % 3 <> 2 THEN pack_info END AS generic_pack,
    CASE product_id % 3 WHEN 0 THEN 'кенче' WHEN 2 THEN 'кутия' END AS pack_type,
    trim(concat_ws(' ', CASE WHEN product_id % 3 <> 2 THEN pack_info END, CASE product_id % 3 WHEN 0 THEN 'кенче' WHEN 2 THEN 'кутия' END)) AS label FROM products""",
)
def pack_components(t):
    pack = F.expr("CASE product_id % 3 WHEN 0 THEN concat_ws(' ', pack_info, 'Кенче') WHEN 1 THEN pack_info ELSE 'КУТИЯ' END")
    x = t("products").select("product_id", names.pack_components(pack).alias("x")).select("product_id", "x.*")
    return x.withColumn("label", text.pack_label(F.col("generic_pack"), F.col("pack_type")))


@query(
    "products",
    """SELECT product_id, CASE WHEN product_id % 2 = 0 THEN coalesce(replace(brand, '#', '-'), 'Milka') END AS brand,
    CASE WHEN product_id % 2 = 0 THEN 'шоколад ' || name ELSE name END AS name FROM products""",
)
def split_brand(t):
    name = F.expr("CASE WHEN product_id % 2 = 0 THEN concat(coalesce(replace(brand, '#', '-'), 'Milka'), ' шоколад ', name) ELSE name END")
    return t("products").select("product_id", names.split_brand(name).alias("x")).select("product_id", "x.*")


@query("products", "SELECT product_id, CASE product_id % 3 WHEN 0 THEN 'Nestlé' WHEN 1 THEN 'Coca-Cola' ELSE brand END AS brand FROM products")
def brand_aliases(t):
    raw = F.expr("CASE product_id % 3 WHEN 0 THEN ' НЕСТЛЕ' WHEN 1 THEN 'COCA-cola ' ELSE brand END")
    return t("products").select("product_id", text.canonical_brand(raw).alias("brand"))


@query(
    "categories",
    """u AS (SELECT id, name, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('category:' || name)) AS h FROM categories)
    SELECT id, name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM u""",
)
def category_uuid(t):
    return t("categories").select("id", "name", names.category_uuid(F.col("name")).alias("uuid"))


@query(
    "",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'BTY-X' || page_id END AS article_id,
    CASE WHEN page_id % 2 = 1 THEN 'https://x/ar/' || (page_id + 1) || '/p/7' END AS next_link FROM pages""",
)
def page_articles(t):
    link = F.expr("CASE WHEN page_id % 2 = 0 THEN concat('/shop/BTY-X', page_id, '/0032') ELSE concat('https://x/ar/', page_id, '/p/7') END")
    return t("pages").select("page_id", text.article_id(link).alias("article_id"), text.next_section(link).alias("next_link"))


@query(
    "prices",
    f"""r AS (SELECT load_key, load_line, product_id, category, price, load_line % 3 <> 0 AND load_line <> 5 AS good FROM prices)
    SELECT load_key * 10 + load_line AS page, 0 AS item_no, category AS name, CAST(price AS DOUBLE) AS price, 'B' || product_id AS brand,
    CASE WHEN load_line % 2 = 0 THEN 20 END AS discount_percent, CASE WHEN load_line % 2 = 0 THEN DATE '2026-04-01' END AS valid_from FROM r WHERE good""",
)
def extraction_offers(t):
    """A response a price row: with and without fences, no products, broken ones."""
    body = """concat('{"items":[{"name":"', category, '","brand":"B', product_id, '","price":"', price, '","is_product":', load_line % 3 <> 0,
        ',"discount_percent":', CASE WHEN load_line % 2 = 0 THEN '"20.0"' ELSE '"?"' END,
        ',"valid_from":"', CASE WHEN load_line % 2 = 0 THEN '2026-04-01' ELSE 'soon' END, '"}]', CASE WHEN load_line = 5 THEN '' ELSE '}' END)"""
    response = f"CASE WHEN load_line % 2 = 0 THEN concat('```json\\n', {body}, '\\n```') ELSE {body} END"
    raw = t("prices").select((F.col("load_key") * 10 + F.col("load_line")).alias("page"), F.expr(response).alias("response"))
    out = offers.extraction_offers(raw).withColumn("price", F.col("price").cast("double"))
    return out.select("page", "item_no", "name", "price", "brand", "discount_percent", "valid_from")


@query(
    "prices",
    """SELECT load_key, load_line, category AS name, CASE load_line % 3 WHEN 0 THEN 'Metro Chef' WHEN 1 THEN 'Metro' END AS brand,
    CASE WHEN load_line % 2 = 0 THEN '6 Х ' || load_line || ' г' WHEN load_line % 5 = 1 THEN 'кашон' END AS pack_info, 'BTY-X' || load_key AS barcode,
    CAST(CASE WHEN load_line = 3 THEN 4 * price ELSE price END AS DOUBLE) AS price, CASE load_line WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 75 END AS discount_percent
    FROM prices""",
)
def listing_offers(t):
    """A card a price row: own labels, sizes in the title, packs shown beside it, one price or two."""
    euro = lambda c: f"concat(replace(cast(cast({c} AS DECIMAL(14,2)) AS STRING), '.', ','), ' €')"
    rows = t("prices").select("load_key", "load_line", "category", "price").repartition(PARTS)  # matching takes more than reading: on all cores
    cards = rows.select(
        "load_key", "load_line",
        F.expr("""concat(CASE load_line % 3 WHEN 0 THEN 'METRO Chef - ' WHEN 1 THEN 'metro ' ELSE '' END, category,
            CASE WHEN load_line % 2 = 0 THEN concat(' 6 Х ', load_line, ' Г') ELSE '' END)""").alias("name"),
        F.expr("concat('/p/BTY-X', load_key, '/1')").alias("href"), F.lit("i?w=80&h=80").alias("image_src"),
        F.expr("CASE load_line % 5 WHEN 0 THEN '1 БРОЙ' WHEN 1 THEN ' КАШОН ' END").alias("pack_info"),
        F.expr(f"CASE WHEN load_line <> 3 THEN {euro('price')} END").alias("promo_eur_text"),
        F.expr(f"CASE WHEN load_line <> 4 THEN {euro('price * 4')} END").alias("strike_eur_text"),
    )
    out = catalog.listing_offers(cards).withColumn("price", F.col("price").cast("double"))
    return out.select("load_key", "load_line", "name", "brand", "pack_info", "barcode", "price", "discount_percent")


@query(
    "prices",
    """c AS (SELECT load_key, load_line, CASE load_line % 4 WHEN 0 THEN 'Сирене' WHEN 1 THEN 'Кафе' WHEN 2 THEN 'Друго' END AS category FROM prices)
    SELECT *, CASE category WHEN 'Сирене' THEN 'Млечни продукти' WHEN 'Кафе' THEN 'Напитки' WHEN 'Друго' THEN 'Друго' END AS top_category FROM c""",
)
def map_category(t):
    raw = F.expr("CASE load_line % 4 WHEN 0 THEN 'Сирене' WHEN 1 THEN 'Кафе' WHEN 2 THEN category WHEN 3 THEN '' END")
    return t("prices").select("load_key", "load_line", L.valid_category(raw).alias("category"), L.top_category(raw).alias("top_category"))


@query(
    "products",
    """SELECT product_id, CASE product_id % 4 WHEN 0 THEN 'Свинско Филе' WHEN 1 THEN NULL WHEN 2 THEN 'Кашкавал Сирене Пица' ELSE name END AS name FROM products""",
)
def script_repair(t):
    raw = F.expr("CASE product_id % 4 WHEN 0 THEN 'Свинскоfilet' WHEN 1 THEN concat('Прясно milk ', name) WHEN 2 THEN 'Кашкавал cheese  PIZZA' ELSE name END")
    return t("products").select("product_id", L.repaired_name(raw).alias("name"))


@query("products", "SELECT product_id, product_id % 5 IN (1, 2) AS rejected FROM products")
def brand_as_name(t):
    raw = t("products").select(
        "product_id", "name",
        F.expr("CASE product_id % 5 WHEN 0 THEN name WHEN 1 THEN 'Lidl ' WHEN 2 THEN 'Милка' ELSE name END").alias("shown"),
        F.expr("CASE product_id % 5 WHEN 0 THEN name WHEN 1 THEN 'lidl' WHEN 2 THEN 'Milka' WHEN 3 THEN NULL ELSE brand END").alias("brand"),
    )
    items = raw.select("product_id", F.col("shown").alias("name"), "brand")
    return chains.without_brand_names(items, raw.select("name")).select("product_id", "rejected")


@query(
    "products",
    """SELECT product_id, CASE WHEN product_id % 3 = 0 THEN substr(sha1(CAST(product_id AS VARCHAR)), 1, 12) ELSE 'creme-' || replace(name, ' ', '-') END
    || CASE WHEN product_id % 2 = 0 THEN '-' || right('3800' || product_id, 4) ELSE '' END AS slug FROM products""",
)
def ascii_slugs(t):
    name = F.expr("CASE WHEN product_id % 3 = 0 THEN 'Мляко!' ELSE concat(' Crème - ', name, '. ') END")
    code = F.expr("CASE WHEN product_id % 2 = 0 THEN concat('3800', product_id) END")
    return t("products").select("product_id", L.ascii_slug(name, code, F.col("product_id")).alias("slug"))


@query("products", "SELECT product_id, name, brand FROM products WHERE status = 'active' AND name = 'blue bolt'")
def family_by_slug(t):
    p = t("products")
    return p.where("status = 'active'").join(chains.resolve_slug(p, "blue-bolt"), "name").select("product_id", "name", "brand")


@query(
    "products prices categories",
    f"""{LATEST}, r AS (SELECT p.name, p.product_id, price, load_key, load_line, category_id,
    coalesce(CASE WHEN load_line % 2 = 0 THEN 'f' || load_key END, CASE WHEN p.product_id % 3 = 0 THEN NULL ELSE 'p' || p.product_id END) AS image
    FROM latest l JOIN products p ON l.product_id = p.product_id WHERE status = 'active'),
    f AS (SELECT name, arg_min(image, (price, load_key, load_line)) FILTER (image IS NOT NULL) AS image, arg_min(category_id, product_id) AS category_id FROM r GROUP BY name)
    SELECT f.name, image, category_id, c.name AS category_name FROM f LEFT JOIN categories c ON f.category_id = c.id""",
)
def family_extras(t):
    p = t("products").withColumn("image_url", F.expr("CASE WHEN product_id % 3 = 0 THEN '' ELSE concat('p', product_id) END"))
    r = t("prices").withColumn("image_url", F.expr("CASE WHEN load_line % 2 = 0 THEN concat('f', load_key) END"))
    return chains.family_extras(p, r, t("categories"))


@query(
    "",
    """SELECT doc_id AS page_id, 'Краве масло Тракия' AS name, CASE WHEN doc_id % 2 = 0 THEN '125 г' END AS unit FROM documents""",
)
def brochure_names(t):
    """A block a document: a line of digits, a name, and a price with or without a unit."""
    block = F.expr("concat('12 ', '\\n Краве масло \\nТракия ', CASE WHEN doc_id % 2 = 0 THEN '125 г ' ELSE '' END, '2.49 лв.')")
    x = t("documents").select(F.col("doc_id").alias("page_id"), L.brochure_name(block).alias("x"))
    return x.select("page_id", F.regexp_replace("x.name", r"\s+", " ").alias("name"), "x.unit")


@query("products", "SELECT DISTINCT name, '' AS category, lower(name) AS normalised FROM products")
def catalog_entries(t):
    return catalog.catalog_entries(t("products").select("name", F.lit(None).cast("string").alias("category")).distinct())


@query(
    "products",
    """f AS (SELECT product_id, min(product_id) OVER (PARTITION BY name, brand, pack_info) AS id_a FROM products)
    SELECT id_a, product_id AS id_b, product_id % 3 = 0 AS "merge", CASE WHEN product_id % 3 = 0 THEN 'N' || product_id END AS canonical_name,
    CASE product_id % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'other' ELSE 'parse error' END AS reason FROM f WHERE id_a <> product_id""",
)
def merge_decisions(t):
    return _decided(t)


def _decided(t):
    answer = """CASE id_b % 3 WHEN 0 THEN concat('```json\\n{"merge": true, "canonical_name": "N', id_b, '", "reason": "same"}\\n```')
        WHEN 1 THEN '{"merge": false, "canonical_name": "", "reason": "other"}' ELSE 'sorry' END"""
    return offers.merge_decisions(chains.equal_products(t("products")).withColumn("response", F.expr(answer)))


@query(
    "products",
    """f AS (SELECT *, min(product_id) OVER (PARTITION BY name, brand, pack_info) AS id_a FROM products),
    m AS (SELECT id_a, min(product_id) AS first FROM f WHERE id_a <> product_id AND product_id % 3 = 0 GROUP BY 1)
    SELECT product_id, coalesce('N' || m.first, name) AS name, CASE WHEN m.first IS NULL THEN brand END AS brand
    FROM f LEFT JOIN m ON m.id_a = f.product_id WHERE NOT (f.id_a <> f.product_id AND f.product_id % 3 = 0)""",
)
def merge_job(t):
    """Equal products, decisions on them, and the merge."""
    left, _ = chains.merge_duplicates(t("products"), t("prices"), _decided(t))
    return left.select("product_id", "name", "brand")


@query(
    "prices products",
    """b AS (SELECT load_key, load_line, store_id, brand, CAST(recorded_at AS DATE) AS day,
      CASE WHEN load_line = 1 THEN NULL WHEN load_line % 2 = 0 THEN CAST(product_id AS VARCHAR) ELSE 'new' END AS known, category AS item FROM prices
      WHERE recorded_at >= TIMESTAMP '1998-01-01'),
    h AS (SELECT DISTINCT CAST(product_id AS VARCHAR) AS known, store_id, brand, CAST(recorded_at AS DATE) AS day, true AS have FROM prices
      WHERE recorded_at < TIMESTAMP '1998-01-01' OR load_line = 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY known, CASE WHEN known = 'new' THEN item END, store_id, brand, day ORDER BY load_key, load_line) AS nth FROM b WHERE known IS NOT NULL)
    SELECT load_key, load_line, CASE WHEN g.known = 'new' THEN NULL ELSE g.known END AS product_id, CASE WHEN g.known = 'new' THEN 'new' ELSE 'barcode' END AS matched_by,
    CASE WHEN nth > 1 OR have THEN 'skipped' ELSE 'inserted' END AS outcome
    FROM g LEFT JOIN h ON g.known = h.known AND g.store_id = h.store_id AND g.brand IS NOT DISTINCT FROM h.brand AND g.day = h.day
    UNION ALL SELECT load_key, load_line, NULL, NULL, 'rejected' FROM b WHERE known IS NULL""",
)
def ingest_job(t):
    """Items of a batch: known barcodes, unknown ones whose names no product is like, and names that are none."""
    new = F.col("recorded_at") >= F.expr("timestamp_ntz'1998-01-01'")
    items = t("prices").where(new).select(
        "load_key", "load_line", "store_id", "price", "recorded_at", "brand",
        F.expr("CASE WHEN load_line = 1 THEN 'Нова' WHEN load_line % 2 = 0 THEN category ELSE concat('Съвсем друго нещо ', category) END").alias("name"),
        F.lit(None).cast("string").alias("pack_info"),
        F.expr("CASE WHEN load_line % 2 = 0 THEN concat('38', product_id) ELSE '' END").alias("barcode"),
    )
    known = t("products").withColumn("barcode", F.expr("concat('38', product_id)"))
    out = chains.ingest(items, known, t("prices").where(~new | (F.col("load_line") == 2)))
    return out.withColumn("product_id", F.when(F.col("matched_by") != "new", F.col("product_id")))


@query(
    "prices products",
    """b AS (SELECT *, CAST(recorded_at AS DATE) AS day, load_key % 8 AS kind FROM prices WHERE recorded_at >= TIMESTAMP '1998-01-01'),
    low AS (SELECT name, brand, pack_info, min(product_id) AS low FROM products GROUP BY ALL),
    x AS (SELECT b.*, CASE WHEN kind < 4 THEN 'barcode' WHEN kind = 4 THEN 'name' WHEN kind < 7 THEN 'new' END AS how,
      CASE WHEN kind < 4 THEN CAST(b.product_id AS VARCHAR) WHEN kind = 4 THEN CAST(low AS VARCHAR) WHEN kind = 5 THEN 'прясно мляко' WHEN kind = 6 THEN 'сирене' END AS target
      FROM b JOIN products p ON p.product_id = b.product_id JOIN low l ON l.name = p.name AND l.brand IS NOT DISTINCT FROM p.brand AND l.pack_info IS NOT DISTINCT FROM p.pack_info),
    h AS (SELECT DISTINCT CAST(product_id AS VARCHAR) AS target, store_id, brand, CAST(recorded_at AS DATE) AS day, true AS have FROM prices WHERE recorded_at < TIMESTAMP '1998-01-01' OR load_line = 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY target, store_id, brand, day ORDER BY load_key, load_line) AS nth FROM x WHERE how IS NOT NULL),
    o AS (SELECT g.load_key, g.load_line, g.price, how AS matched_by, CASE WHEN nth > 1 OR have THEN 'skipped' ELSE 'inserted' END AS outcome,
      CASE WHEN kind = 5 THEN 'Прясно мляко' WHEN kind = 6 THEN 'Сирене' WHEN kind = 4 THEN 'Друго' ELSE '' END AS category
      FROM g LEFT JOIN h ON g.target = h.target AND g.store_id = h.store_id AND g.brand IS NOT DISTINCT FROM h.brand AND g.day = h.day)
    SELECT load_key, load_line, matched_by, outcome, category, CASE WHEN outcome = 'inserted' THEN CAST(price AS DOUBLE) END AS appended FROM o
    UNION ALL SELECT load_key, load_line, NULL, 'rejected', '', NULL FROM x WHERE how IS NULL""",
)
def ingest_whole(t):
    """A batch by every way that an item can go: barcodes, fuzzy names, a catalog name, a decision, no name, and prices that are there."""
    new = F.col("recorded_at") >= F.expr("timestamp_ntz'1998-01-01'")
    own = t("products").select("product_id", "name", "brand", "pack_info")
    rows = t("prices").where(new).drop("brand", "category").join(own, "product_id")
    way = lambda *x: F.expr("CASE load_key % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in zip((4, 5, 6, 7), x[:4])) + f" ELSE {x[4]} END")
    items = rows.select(
        "load_key", "load_line", "store_id", "price", "recorded_at", "brand",
        way("concat(name, 's')", "'Мляко прясно!'", "'нещо неясно'", "CASE WHEN load_line % 2 = 0 THEN 'Нова' ELSE ' я' END", "name").alias("name"),
        way("pack_info", "NULL", "NULL", "pack_info", "pack_info").alias("pack_info"),
        way("''", "NULL", "''", "NULL", "concat('38', product_id)").alias("barcode"),
        way("'Друго'", "'Друго'", "NULL", "''", "''").alias("category"), F.concat(F.lit("i"), "load_key").alias("image_url"), F.lit(None).cast("string").alias("additional_info"),
    )
    spark = items.sparkSession
    catalog_rows = spark.createDataFrame([(1, "Прясно мляко", "Прясно мляко"), (2, "Сирене", "Сирене")], "ordinal long, name string, category string")
    told = spark.createDataFrame([("нещо неясно", "Сирене", None, None, "краве")], "raw_title string, catalog_match string, brand string, pack_info string, additional_info string")
    known = t("products").withColumn("barcode", F.expr("concat('38', product_id)"))
    path = folder(spark, "ingest")
    history = t("prices").where(~new | (F.col("load_line") == 2))
    out, _, _ = chains.ingest_batch(items, known, history, catalog_rows, path, "batch-1998", told, every="month")
    appended = facts.read_facts(spark, path, out.schema)
    gone = out.where("outcome <> 'inserted'").withColumn("appended", F.lit(None).cast("double"))
    every = appended.withColumn("appended", F.col("price").cast("double")).unionByName(gone, allowMissingColumns=True)
    return every.select("load_key", "load_line", "matched_by", "outcome", F.coalesce("category", F.lit("")).alias("category"), "appended")


Q.ORACLE["stream_stale"] = """SELECT CAST(user_id % 80 AS BIGINT) AS store_id, max(ts) FILTER (event_type <> 'view') AS beat,
    coalesce(max(ts) FILTER (event_type <> 'view') < (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND, true) AS stale FROM events GROUP BY 1"""


def _stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import jobs

    out = jobs.stale_stores(jobs.runs_stream(spark, sf_dir))
    return out.select(F.col("store_id").cast("long").alias("store_id"), F.col("beat").cast("timestamp_ntz").alias("beat"), "stale")


Q.QUERIES["stream_stale"] = _stream_stale
