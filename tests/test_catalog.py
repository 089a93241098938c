"""Every catalogue query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from waymark.plans import catalog, catalog_core, catalog_paths, catalog_run  # noqa: F401  all register queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.SQL:
        assert rows
        return
    result = db.execute(catalog.SQL[name])
    want = canonical(result.fetchall(), [d[0] for d in result.description])
    assert canonical(rows, got.columns) == want
