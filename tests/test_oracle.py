"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from siftwright import queries

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(ROOT):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{ROOT}/{name}')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, ROOT)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = duck.sql(queries.SQL[name])
    assert got == plain(rel.fetchall(), rel.columns)
