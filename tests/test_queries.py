"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import pathlib

import duckdb
import pytest

from tidemark.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in pathlib.Path(SF).glob("*.parquet")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.5g}"
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    sql = duck.sql(Q.ORACLE_SQL[name])
    assert cols == sorted(sql.columns)
    want = sorted(tuple(plain(x) for x in r) for r in duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({Q.ORACLE_SQL[name]}) z").fetchall())
    assert got == want


def test_every_query_has_columns(spark):
    """Names are unique and every oracle belongs to a query."""
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES) and len(Q.QUERIES) > 100


def test_jobs_over_all_keys(spark, duck):
    """Tests and graphs of all symbols."""
    symbols = {r[0] for r in duck.sql("select distinct l_returnflag from lineitem").fetchall()}
    assert {r["symbol"] for r in Q.QUERIES["k11_ci_tests"](spark, SF).collect()} == symbols
    assert "symbol" in Q.QUERIES["k12_causal_graph"](spark, SF).columns
