"""Every registered query with an oracle gives what DuckDB gives on the same tables; the others give rows."""

import math
import os

import duckdb
import pytest

from tracewright.plans import catalog
from tracewright.plans.bindings import TABLES

catalog.load()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        return f"{float(value) + 0.0:.8g}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    got = frame.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, got) == rows(names, cursor.fetchall())
