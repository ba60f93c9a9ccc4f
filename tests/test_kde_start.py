"""Densities of series whose first rows lie between the points of the grid."""

import math

import numpy as np
import pytest

from tidemark.operators import kde
from tidemark.plans import queries as Q


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_a_start_without_mass(spark, chunk):
    """The density is not a number, as the ratio that it is in SQL; dynamic_kde begins uniform. Other series keep theirs."""
    x = np.r_[np.tile([0.0, 100.0], 15), np.linspace(0, 100, 30)]
    rows = [("wide", i, float(v)) for i, v in enumerate(x)] + [("near", i, float(v) / 100) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    got = {(r["k"], r["row"], r["point"]): r["density"] for r in kde.density_at(df, "x", ["k"], "i", [19, 20, 50], h=0.2, omega=0.9, t0=20, points=8, chunk=chunk).collect()}
    assert len(got) == 48 and all(v is not None and math.isnan(v) == (k == "wide") for (k, *_), v in got.items())
    first = kde.dynamic_kde(df.filter("k = 'wide'"), "x", ["k"], "i", h=0.2, omega=0.9, t0=20, points=8, at=[19], chunk=chunk).first()
    assert np.allclose(first["density"], 1 / 130)


def test_query_of_larger_sums_equals_sql(spark, tmp_path):
    """Sums as of 600 line items for each one: the steps of the grid are wider than the kernel."""
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "events"):
        more = " replace (l_extendedprice * 600 as l_extendedprice)" if t == "lineitem" else ""
        c.sql(f"copy (select *{more} from '/root/testdata/sf0.01/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    sql = c.sql(f"select symbol, row, point, density from ({Q.ORACLE_SQL['k8_density_at']}) z").fetchall()
    got = {tuple(r[c] for c in ("symbol", "row", "point")): r["density"] for r in Q.QUERIES["k8_density_at"](spark, str(tmp_path)).collect()}
    assert len(got) == len(sql) and any(math.isnan(r[3]) for r in sql) and all(got[r[:3]] == pytest.approx(r[3], abs=1.5e-6, nan_ok=True) for r in sql)
