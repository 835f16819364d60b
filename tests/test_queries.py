"""Every price query with SQL, Spark against DuckDB on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from pricelattice.plans import desk_queries, listing_queries  # noqa: F401 - registers its queries
from pricelattice.plans.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 4)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:19]
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        done = duck.execute(ORACLE[name])
        assert got == rows([d[0] for d in done.description], done.fetchall())
