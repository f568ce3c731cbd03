"""The driver's contract, and every query against its oracle on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from grovekit.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    found = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = plain(found.select(*columns).collect())
    if name in catalog.ORACLES:
        expected = tables.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})")
        assert sorted(tables.sql(catalog.ORACLES[name]).columns) == columns
        assert rows == plain(expected.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 209
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
