import datetime
from decimal import Decimal

from pricelattice.operators import prices as P


def test_a_product_is_one_row_before_its_family(spark):
    """Ties of the latest time, no price, no store, products without prices; no set of stores is kept apart for a product."""
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, 1, 9, 2), (1, 1, 7, 2), (1, 1, 1, 1), (1, 2, 8, 1), (1, None, 6, 1), (2, 1, None, 3), (2, 3, 5, 1), (3, 3, 2, 1), (3, 3, None, 1)]
    prices = spark.createDataFrame([(p, s, c and Decimal(c), day(d)) for p, s, c, d in rows], "product_id long, store_id long, price decimal(12,2), recorded_at timestamp_ntz")
    names = [(1, "a", "X", "2 л", "active"), (2, "a", "x ", None, "active"), (3, None, None, "1 кг", "active"), (4, "b", None, None, "active"), (5, "a", "Y", None, "gone")]
    products = spark.createDataFrame(names, "product_id long, name string, brand string, pack_info string, status string")
    out = P.product_summary(products, prices)
    got = {r.product_id: (r.min_price, r.n_stores, r.updated_at) for r in out.collect()}
    assert got == {1: (6, 2, day(2)), 2: (5, 2, day(3)), 3: (2, 1, day(1)), 4: (None, 0, None), 5: (None, 0, None)}
    families = {r.name: tuple(r)[1:] for r in P.families(products, prices).collect()}
    assert families == {"a": (1, 1, 3, 2, 5, 3, "л", day(3)), None: (0, 1, 1, 1, 2, 2, "кг", day(1)), "b": (0, 0, 0, 1, None, None, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and plan.count("Repartition") == 1
