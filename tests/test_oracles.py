"""Every registered query against its SQL in DuckDB, at the smallest scale: rows, column names and values."""

import os
from decimal import Decimal

import duckdb
import pytest

from millrace import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], Decimal) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
