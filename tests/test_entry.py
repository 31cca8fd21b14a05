"""The driver contract, with SQL run against every query that has it (on the smallest data)."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

import __spark_entry__ as entry  # noqa: E402

Q, SQL = entry.queries(), entry.oracle_sql()


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["cell_id", "n"] and df.count() > 0
    assert set(SQL) <= set(Q)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.4f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, duck, name):
    df = Q[name](spark, DATA)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)
