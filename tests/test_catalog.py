"""Queries against their SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from spindrift import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return tuple(x) if isinstance(x, list) else float(x) if type(x).__name__ == "Decimal" else x


def rows(cols, data):
    order = sorted(cols)
    return sorted((tuple(plain(r[list(cols).index(c)]) for c in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = con.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, found.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
