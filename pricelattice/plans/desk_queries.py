"""Registered queries of the moderation desk and the scraper's books: rejections, logs, links, checks, search and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, packs
from ..functions import listing as L
from ..operators import chains
from ..operators import prices as P
from ..operators import tables as T
from ..sources import offers
from . import queries as Q
from .queries import LATEST, LINES, ORACLE, query


@query(
    "products",
    """SELECT l_orderkey AS product_id, l_linenumber AS nth, CASE WHEN status IS NULL THEN 'not found' WHEN status <> 'pending_review' THEN 'not pending'
    WHEN l_linenumber > min(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 'not found' ELSE 'rejected' END AS outcome
    FROM lineitem LEFT JOIN products ON product_id = l_orderkey""",
)
def reject_outcomes(t):
    """Every order line asks to reject the product of its order's number: many there are not, some are active, some are asked for again."""
    asked = t("lineitem").select(F.col("l_orderkey").alias("product_id"), F.col("l_linenumber").alias("nth"))
    return T.rejections(t("products"), asked, "nth")


@query(
    "",
    """SELECT event_id, CASE WHEN event_id % 7 = 1 THEN '' ELSE CAST(user_id AS VARCHAR) END AS store,
    CASE WHEN event_id % 7 = 2 THEN 'INFO' ELSE upper(event_type) END AS level, 'took "' || event_id || '" s' AS msg, strftime(ts, '%Y-%m-%d') AS ts
    FROM events WHERE event_id % 7 < 3 ORDER BY events.ts DESC, event_id DESC LIMIT 200""",
)
def log_entries(t):
    """The newest 200 good ones of an entry an event: whole, without store, without level, cut off, a list, a number as level, a null message."""
    body = """CASE event_id % 7
        WHEN 0 THEN concat('{"ts":"', day, '","store":"', user_id, '","level":"', upper(event_type), '","msg":"took \\\\"', event_id, '\\\\" s","more":[1]}')
        WHEN 1 THEN concat('{"ts":"', day, '","level":"', upper(event_type), '","msg":"took \\\\"', event_id, '\\\\" s"}')
        WHEN 2 THEN concat(' {"msg":"took \\\\"', event_id, '\\\\" s","store":"', user_id, '","ts":"', day, '"}')
        WHEN 3 THEN concat('{"ts":"', day, '","store":"') WHEN 4 THEN concat('["', day, '"]')
        WHEN 5 THEN concat('{"ts":"', day, '","level":', event_id, '}') ELSE '{"msg":null}' END"""
    raw = t("events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("entry", F.expr(body))
    good = offers.log_entries(raw.select("event_id", F.col("ts").alias("at"), "entry"))
    return good.orderBy(F.desc("at"), F.desc("event_id")).limit(200).select("event_id", "ts", "store", "level", "msg")


@query("stores", "SELECT store_id, store_slug FROM stores WHERE active AND (brochure_url IS NOT NULL OR listing_url IS NOT NULL)")
def stores_to_scrape(t):
    due = t("stores").where(F.col("active") & (F.col("brochure_url").isNotNull() | F.col("listing_url").isNotNull()))
    return due.select("store_id", "store_slug")


_PAGE = """CASE page_id % 5 WHEN 0 THEN {re}(html, 'href="(/t[^"]*)"', 'href="{one}.pdf"'{g}) WHEN 1 THEN concat(html, '<iframe class="v" src="https://view.publitas.com/x/', page_id, '/?embed=1"></iframe>')
    WHEN 2 THEN concat(replace(html, 'href="/t', 'href="/broshura/t'), '<!-- <a href="/x.pdf">x</a> -->') WHEN 3 THEN concat(html, '<a title="x" href=''//issuu.com/b&amp;c''>y</a><a href="', url, '">own</a>') ELSE html END"""


@query(
    "",
    "WITH p AS (SELECT page_id, url, " + _PAGE.format(re="regexp_replace", one="\\1", g=", 'g'") + """ AS html FROM pages),
    b AS (SELECT *, regexp_replace(html, '<!--.*?-->', ' ', 'gs') AS bare, regexp_extract(url, '^\\w+://[^/?#]+') AS site FROM p),
    a AS (SELECT *, list_transform(regexp_extract_all(bare, '<a (?:[^>]*? )?href=["'']?([^"''\\s>]+)', 1),
      lambda x: CASE WHEN x LIKE 'http%' THEN x WHEN x LIKE '//%' THEN regexp_extract(url, '^\\w+:') || replace(x, '&amp;', '&') ELSE site || x END) AS links,
      list_transform(regexp_extract_all(bare, '<iframe [^>]*src="([^"?]+)', 1), lambda x: rtrim(x, '/') || '/') AS frames FROM b),
    c AS (SELECT page_id, CASE WHEN len(list_filter(links, lambda x: lower(x) LIKE '%.pdf%')) > 0 THEN list_filter(links, lambda x: lower(x) LIKE '%.pdf%')
      WHEN len(frames) > 0 THEN frames ELSE list_filter(links, lambda x: regexp_matches(x, '/broshura/|issuu\\.com/') AND rtrim(x, '/') <> rtrim(url, '/')) END AS found FROM a)
    SELECT DISTINCT page_id, href, CASE WHEN lower(href) LIKE '%.pdf' THEN 'pdf' ELSE 'viewer' END AS kind FROM (SELECT page_id, unnest(found) AS href FROM c)""",
)
def page_brochures(t):
    """Brochure links out of every page: to files, embedded viewers, linked viewers, or none."""
    page = F.expr(_PAGE.format(re="regexp_replace", one="$1", g=""))
    p = t("pages").select("page_id", F.explode(dates.brochure_links(page, F.col("url"))).alias("href"))
    return p.withColumn("kind", F.when(F.lower("href").endswith(".pdf"), "pdf").otherwise("viewer"))


def _compared(words: str) -> str:
    return f"""{LATEST}, hit AS (SELECT product_id, name, brand AS own_brand FROM products WHERE status = 'active' AND name ILIKE '%{words}%' ORDER BY name, product_id LIMIT 5)
    SELECT hit.product_id, name, own_brand, store_id, store_name, CAST(price AS DOUBLE) AS price, count(*) OVER (PARTITION BY hit.product_id) AS n_stores
    FROM hit JOIN latest USING (product_id) JOIN stores USING (store_id)
    QUALIFY row_number() OVER (PARTITION BY hit.product_id ORDER BY price, store_id, load_key, load_line) = 1"""


@query("products prices stores", _compared("lue bol").replace("count(*) OVER", "count(DISTINCT store_id) OVER"))
def search_compare_part(t):
    """Search and compare for a part of a word, which only the fallback finds."""
    return chains.search_compare(t("products"), t("prices"), t("stores"), "lue bol").withColumn("price", F.col("price").cast("double"))


@query(
    "prices",
    """SELECT load_key AS page_id, load_line AS line_no, category AS line, CAST(floor(price / 10000) AS BIGINT) AS band FROM prices
    QUALIFY row_number() OVER (PARTITION BY load_key, lower(trim(category)), floor(price / 10000) ORDER BY load_line) = 1""",
)
def offer_page_dedup(t):
    """The first of the offers of a page with one name and one price (in steps of 10,000)."""
    rows = t("prices").select(
        F.col("load_key").alias("page_id"), F.col("load_line").alias("line_no"), F.col("category").alias("line"),
        F.floor(F.col("price") / 10_000).cast("long").alias("band"),
    )
    return T.page_dedup(rows, ("band",))


_KINDS = [*packs.CEILINGS, "Друго"]


@query(
    "prices products",
    f"""{LATEST}, lim(k, kind, most) AS (VALUES {", ".join(f"({k}, '{c}', {packs.CEILINGS.get(c, 'NULL')})" for k, c in enumerate(_KINDS))}),
    r AS (SELECT l.load_key, l.load_line, kind, most, CASE WHEN regexp_matches(pack_info, '^[0-9]+ г$')
      THEN (CAST(price AS DOUBLE) / 5000) / (CAST(split_part(pack_info, ' ', 1) AS DOUBLE) / 1000) END AS per_kilo
      FROM latest l JOIN products p ON l.product_id = p.product_id JOIN lim ON k = l.product_id % {len(_KINDS)})
    SELECT load_key, load_line, kind, per_kilo, coalesce(per_kilo <= most, true) AS plausible FROM r""",
)
def price_ceilings(t):
    """Prices (a 5000th of them) per kilogram against the ceilings of all categories, and of one that has none."""
    rows = P.latest_prices(t("prices")).join(t("products").select("product_id", "pack_info"), "product_id")
    kind = F.element_at(F.array(*[F.lit(c) for c in _KINDS]), (F.col("product_id") % len(_KINDS) + 1).cast("int"))
    price = F.col("price").cast("double") / 5000
    return rows.select(
        "load_key", "load_line", kind.alias("kind"), packs.euro_per_kilo(price, F.col("pack_info")).alias("per_kilo"),
        packs.plausible(price, F.col("pack_info"), kind).alias("plausible"),
    )


@query(
    "brochures",
    """d AS (SELECT brochure_id, valid_from AS a, valid_from + 9 AS b, brochure_id % 4 AS kind FROM brochures WHERE valid_from IS NOT NULL),
    r AS (SELECT *, CASE WHEN kind = 0 THEN try_cast('2026-' || strftime(a, '%m-%d') AS DATE) WHEN kind = 3 THEN NULL ELSE CAST(strftime(a, '20%y-%m-%d') AS DATE) END AS x,
      CASE kind WHEN 3 THEN NULL ELSE try_cast(CASE WHEN kind = 0 THEN '2026' ELSE strftime(b, '20%y') END || strftime(b, '-%m-%d') AS DATE) END AS y FROM d)
    SELECT brochure_id, CASE WHEN y IS NOT NULL THEN x END AS valid_from, CASE WHEN x IS NOT NULL THEN y END AS valid_to FROM r""",
)
def brochure_ranges(t):
    """Validity texts of all brochures with a day: without years, with two and with four digits of them, and one that is no range."""
    text = """CASE brochure_id % 4
        WHEN 0 THEN concat('Оферта ', date_format(valid_from, 'd.M'), ' до ', date_format(date_add(valid_from, 9), 'dd.MM'))
        WHEN 1 THEN concat(date_format(valid_from, 'dd/MM/yy'), '-', date_format(date_add(valid_from, 9), 'dd/MM/yy'), ' г.')
        WHEN 2 THEN concat('валидно ', date_format(valid_from, 'dd.MM.'), '20', date_format(valid_from, 'yy'), ' – ', date_format(date_add(valid_from, 9), 'dd.MM.'), '20', date_format(date_add(valid_from, 9), 'yy'))
        ELSE concat('от ', date_format(valid_from, 'dd.MM.yyyy')) END"""
    rows = t("brochures").where("valid_from is not null").select("brochure_id", dates.date_range(F.expr(text), 2026).alias("r"))
    return rows.select("brochure_id", "r.valid_from", "r.valid_to")


@query(
    "products",
    """SELECT product_id, 'НОВО ' || name AS name, CASE WHEN product_id % 2 = 0 THEN product_id || ' г' END AS unit FROM products""",
)
def flyer_names(t):
    """A flyer's block a product: its number, a mark, its name, and a price with or without a size."""
    block = F.expr("concat(product_id, '\\n НОВО \\n', name, '\\n', CASE WHEN product_id % 2 = 0 THEN concat(product_id, ' г ') ELSE '' END, product_id % 90, ',49 лв.')")
    x = t("products").select("product_id", L.brochure_name(block).alias("x"))
    return x.select("product_id", F.regexp_replace("x.name", r"\s+", " ").alias("name"), "x.unit")


@query(
    "prices",
    """SELECT load_key, load_line, 'Бяло-Сирене O''Neil 3В1 ' || upper(category[1]) || lower(category[2:]) AS name, CASE load_line % 3 WHEN 0 THEN 'BGN' ELSE 'EUR' END AS currency,
    CASE WHEN load_line % 2 = 0 THEN load_line || ' г' END AS unit, CAST(load_key AS VARCHAR) AS barcode FROM prices""",
)
def clean_offers(t):
    raw = t("prices").select(
        "load_key", "load_line", F.concat(F.lit("  бЯЛО-СИРЕНЕ o'neil 3в1 "), "category", F.lit("\t")).alias("name"),
        F.expr("CASE load_line % 3 WHEN 0 THEN 'BGN' WHEN 1 THEN '' END").alias("currency"),
        F.expr("CASE WHEN load_line % 2 = 0 THEN concat(' ', load_line, ' г\\n') END").alias("unit"), F.concat(F.lit(" "), "load_key").alias("barcode"),
    )
    return offers.clean_offers(raw)


_NAMED = "CASE WHEN (product_id + load_line) % 4 = 0 THEN NULL WHEN product_id % 9 = 0 THEN 'NONE' ELSE {pick} END"
_OWN_ID = "CASE WHEN product_id % 3 = 0 THEN category_id END"


@query(
    "products prices categories",
    f"""k AS (SELECT row_number() OVER (ORDER BY id) - 1 AS nth, count(*) OVER () AS n, name FROM categories),
    r AS (SELECT product_id, recorded_at, load_key, load_line, {_NAMED.format(pick="k.name")} AS category FROM prices JOIN k ON nth = load_key % n),
    last AS (SELECT product_id, arg_max(category, (recorded_at, load_key, load_line)) AS name FROM r WHERE category IS NOT NULL GROUP BY 1),
    c AS (SELECT name, min(id) AS cid FROM categories GROUP BY 1)
    SELECT p.product_id, coalesce({_OWN_ID.replace("product_id", "p.product_id")}, cid) AS category_id FROM products p LEFT JOIN last USING (product_id) LEFT JOIN c ON c.name = last.name""",
)
def backfill_category_id(t):
    """Prices name categories by turns, some none and some an unknown one; a third of the products has its own already."""
    c = t("categories").select("id", "name")
    names = c.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("all"))  # the category table in one row, broadcast
    pick = "element_at(all, cast(load_key % size(all) as int) + 1).name"
    rows = t("prices").drop("category").join(F.broadcast(names), F.lit(True)).withColumn("category", F.expr(_NAMED.format(pick=pick))).drop("all")
    own = t("products").withColumn("category_id", F.expr(_OWN_ID))
    return T.backfill_category_id(own, rows, c).select("product_id", F.col("category_id").cast("long").alias("category_id"))


@query(
    "products prices",
    """m AS (SELECT product_id, 'B' || (load_key % 3) AS mb FROM prices WHERE load_key % 5 <> 0 GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY count(*) DESC, mb) = 1)
    SELECT product_id, CASE WHEN product_id % 4 = 2 THEN 'шоколад ' || name WHEN product_id % 4 = 3 THEN 'Milka шоколад' ELSE name END AS name,
    CASE product_id % 4 WHEN 2 THEN 'Milka' WHEN 3 THEN 'own' ELSE mb END AS brand FROM products LEFT JOIN m USING (product_id)""",
)
def backfill_brands(t):
    """Names with and without a brand before them, products with and without one, prices of several brands a product."""
    own = t("products").select(
        "product_id", F.expr("CASE product_id % 4 WHEN 2 THEN concat('Milka шоколад ', name) WHEN 3 THEN 'Milka шоколад' ELSE name END").alias("name"),
        F.expr("CASE WHEN product_id % 4 = 3 THEN 'own' END").alias("brand"),
    )
    rows = t("prices").withColumn("brand", F.expr("CASE WHEN load_key % 5 <> 0 THEN concat('B', load_key % 3) END"))
    return T.backfill_brands(own, rows)


@query(
    "products prices",
    """r AS (SELECT product_id, load_key, load_line, CASE WHEN load_key % 2 = 0 THEN 'c' || load_key END AS c, CASE WHEN load_line = 2 THEN 'i' || load_key END AS i,
      CASE WHEN load_key % 3 = 0 AND load_line > 3 THEN 'a' || load_line END AS a FROM prices),
    f AS (SELECT product_id, arg_min(c, (load_key, load_line)) FILTER (c IS NOT NULL) AS c, arg_min(i, (load_key, load_line)) FILTER (i IS NOT NULL) AS i,
      arg_min(a, (load_key, load_line)) FILTER (a IS NOT NULL) AS a FROM r GROUP BY 1)
    SELECT product_id, CASE WHEN product_id % 2 = 1 THEN 'own' ELSE c END AS category, i AS image_url, a AS additional_info FROM products LEFT JOIN f USING (product_id)""",
)
def enrich_all(t):
    """Category, image and additional information of products, each from the first price row that has it."""
    own = t("products").select("product_id", F.expr("CASE WHEN product_id % 2 = 1 THEN 'own' ELSE '' END").alias("category"))
    rows = t("prices").select(
        "product_id", "load_key", "load_line", F.expr("CASE WHEN load_key % 2 = 0 THEN concat('c', load_key) END").alias("category"),
        F.expr("CASE WHEN load_line = 2 THEN concat('i', load_key) ELSE '' END").alias("image_url"),
        F.expr("CASE WHEN load_key % 3 = 0 AND load_line > 3 THEN concat('a', load_line) END").alias("additional_info"),
    )
    return T.enrich_columns(own, rows, ["category", "image_url", "additional_info"])


#: SQL of queries that had none.
PRICE_SQL = r"""([0-9]{1,4})[.,\s]([0-9]{2})"""
ORACLE["name_slugs"] = Q.with_tables("products") + r"""SELECT product_id, regexp_replace(regexp_replace(
    translate(lower(concat_ws(' ', name, pack_info)), 'лгмбр', 'lgmbr'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM products"""
_PRICED = f"""WITH {LINES}, q AS (SELECT *, lag(line) OVER w AS up, lag(line, 2) OVER w AS upper FROM l WINDOW w AS (PARTITION BY page_id ORDER BY line_no))
    SELECT page_id, line_no, line, CAST(regexp_extract(line, '{PRICE_SQL}', 1) || '.' || regexp_extract(line, '{PRICE_SQL}', 2) AS DOUBLE) AS price"""
ORACLE["brochure_prices"] = f"{_PRICED} FROM q WHERE regexp_matches(line, '{PRICE_SQL}')"
ORACLE["brochure_offers"] = f"{_PRICED}, concat_ws(chr(10), upper, up, line) AS block FROM q WHERE regexp_matches(line, '{PRICE_SQL}')"
ORACLE["price_sanity"] = Q.with_tables("prices", "products") + f""", {LATEST}, r AS (SELECT l.load_key, l.load_line, CASE WHEN regexp_matches(pack_info, '^[0-9]+ г$')
      THEN CAST(price AS DOUBLE) / (CAST(split_part(pack_info, ' ', 1) AS DOUBLE) / 1000) END AS per_kilo FROM latest l JOIN products p ON l.product_id = p.product_id)
    SELECT load_key, load_line, per_kilo, coalesce(per_kilo <= {packs.CEILINGS["Плодове"]}, true) AS plausible FROM r"""
