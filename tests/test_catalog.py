"""Each query with oracle SQL against DuckDB on the smallest tables."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from gritstone.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(table):
    """Rows as text, columns by name: Arrow values, so integers with nulls stay integers."""
    columns = sorted(table.column_names)
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, duck, name):
    want = duck.sql(catalog.ORACLES[name]).to_arrow_table()
    assert want.num_rows, "a query without rows shows nothing"
    assert rows(catalog.QUERIES[name](spark, SF).toArrow()) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_without_sql(spark, name):
    """Queries that SQL cannot express run over the whole table; what they give is tested on small tables elsewhere."""
    assert catalog.QUERIES[name](spark, SF).count() > 0
