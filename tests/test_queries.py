"""Every query with SQL against an independent engine on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from cairn import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    """Queries without SQL: rows, and their columns known; what the rows are is tested against brute force elsewhere."""
    out = QUERIES[name](spark, sf)
    rows = out.limit(5).collect()
    assert rows or name.startswith("op") or name == "pipeline"
    assert all(set(r.asDict()) == set(out.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
