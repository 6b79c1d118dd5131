"""Every registered filter query against DuckDB on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sketchfield import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables aren't here")


def rounded(v):
    return float(f"{float(v):.8g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in queries.SQL:
        assert got
        return
    result = duck.execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(rounded(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
