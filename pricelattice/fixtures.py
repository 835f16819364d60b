"""Price tables over the driver's star schema, each as one SELECT that Spark SQL and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Base tables by the adapter that reads them.
BASES = {
    "products": ["part"],
    "prices": ["lineitem", "part"],
    "stores": ["supplier"],
    "categories": ["nation", "region"],
    "scrape_runs": ["events"],
    "brochures": ["orders"],
}

SELECTS = {
    "products": """
SELECT p_partkey AS product_id, p_name AS name,
       CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_brand END AS brand,
       CASE p_size % 5 WHEN 0 THEN concat(CAST(p_size AS STRING), ' л')
                       WHEN 1 THEN concat(CAST(p_size * 10 AS STRING), ' г')
                       WHEN 2 THEN concat('6 x ', CAST(p_size AS STRING), ' мл')
                       WHEN 3 THEN concat(CAST(p_size AS STRING), ' бр') END AS pack_info,
       CAST(p_partkey % 25 AS INT) AS category_id,
       CASE WHEN p_partkey % 10 = 0 THEN 'pending_review' ELSE 'active' END AS status,
       make_date(2024, CAST(1 + p_partkey % 12 AS INT), CAST(1 + p_partkey % 28 AS INT)) AS created_on
FROM part""",
    "prices": """
SELECT l_partkey AS product_id, l_suppkey AS store_id,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS price, 'EUR' AS currency,
       l_shipdate AS recorded_at,
       CASE WHEN l_returnflag = 'R' THEN 'brochure' ELSE 'web' END AS source,
       CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_brand END AS brand,
       CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS top_category,
       split_part(p_name, ' ', 2) AS category,
       CASE WHEN p_size = 1 THEN NULL ELSE split_part(p_name, ' ', 1) END AS product_type,
       CAST(round(l_discount * 100) AS INT) AS discount_percent,
       l_orderkey AS load_key, l_linenumber AS load_line
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "stores": """
SELECT s_suppkey AS store_id, s_name AS store_name,
       lower(replace(s_name, '#', '-')) AS store_slug, s_suppkey % 7 <> 0 AS active,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('https://shop/', s_name, '/flyers') END AS brochure_url,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('https://shop/', s_name, '/offers') END AS listing_url
FROM supplier""",
    "categories": """
SELECT n_nationkey AS id, n_name AS name, 100 + n_regionkey AS parent_id FROM nation
UNION ALL SELECT 100 + r_regionkey, r_name, 1000 FROM region
UNION ALL SELECT 1000, 'ALL', CAST(NULL AS INT)""",
    "scrape_runs": """
SELECT event_id AS run_id, user_id % 80 AS store_id, ts AS started_at,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
                       WHEN 'signup' THEN 'cancelled' ELSE 'completed' END AS status,
       CASE WHEN value < 5 THEN 0 ELSE CAST(floor(value) AS INT) END AS items_found
FROM events""",
    "brochures": """
SELECT o_orderkey AS brochure_id, o_custkey % 100 AS store_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS valid_from,
       o_orderstatus = 'O' AS is_current
FROM orders""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A price table by name (or a base table as it is)."""
    if name not in SELECTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frames = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASES[name]}
    text = SELECTS[name]
    for b in BASES[name]:
        text = text.replace(f"FROM {b}", f"FROM {{{b}}} AS {b}").replace(f"JOIN {b}", f"JOIN {{{b}}} AS {b}")
    return spark.sql(text, **frames)


def with_tables(*names: str) -> str:
    """The adapters as the head of a DuckDB query."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SELECTS[n]})" for n in names) + "\n"
