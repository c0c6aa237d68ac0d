"""Every query against its DuckDB equivalent, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from pulseframe.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def comparable(found):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = comparable(tuple(r) for r in found.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    relation = duck.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    assert got == comparable(duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({catalog.ORACLES[name]})").fetchall())


def test_contract(spark):
    queries = driver.queries()
    assert set(catalog.QUERIES) <= set(queries) and set(driver.oracle_sql()) <= set(queries)
    assert driver.entry(spark).count() == 5
