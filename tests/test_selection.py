"""Percentiles by narrowing against Spark's own, and ranks over cuts against plain windows."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import selection

AT = {"p0": 0.0, "p1": 0.01, "q25": 0.25, "mid": 0.5, "p99": 0.99, "p100": 1.0}


def equal(got, want):
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert (a is None and b is None) or (a != a and b != b) or a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12), (k, got[k], want[k])


def by_key(df):
    return {r["k"]: tuple(r[c] for c in AT) for r in df.select("k", *AT).collect()}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [("wide", rng.lognormvariate(0, 4)) for _ in range(20_000)] + [("ties", float(rng.choice([1, 1, 1, 1, 2, 3, 9]))) for _ in range(9_000)]
    rows += [("one", 5.0)] * 3_000 + [(None, rng.random()) for _ in range(2_000)] + [("few", 1.0), ("few", None), ("few", 4.0), ("null", None)]
    rows += [("odd", x) for x in [math.nan, math.inf, -math.inf] * 400] + [("odd", rng.gauss(0, 1)) for _ in range(3_000)]
    return spark.createDataFrame(rows, "k string, x double").repartition(7).persist()


@pytest.mark.parametrize("most", [0, 50, 1_500, 10**9])
def test_percentiles(table, most):
    want = by_key(table.groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(c) for c, p in AT.items()]))
    equal(by_key(selection.percentiles(table, ["k"], "x", AT, most=most)), want)


def test_percentiles_without_keys_or_rows(table):
    rows = table.filter("k = 'wide'")
    want = rows.agg(F.percentile("x", F.lit(0.3))).first()[0]
    assert selection.percentiles(rows, [], "x", {"p": 0.3}, most=100).first()["p"] == pytest.approx(want, rel=1e-12)
    assert selection.percentiles(table.filter("false"), ["k"], "x", AT, most=1).count() == 0


def test_wrong_bounds_are_not_used(table, monkeypatch):
    """A sketch that is off by far more than it says costs a pass, not the result."""
    monkeypatch.setattr(selection, "ACCURACY", 3)
    monkeypatch.setattr(selection, "GRID", 50)
    want = by_key(table.groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(c) for c, p in AT.items()]))
    equal(by_key(selection.percentiles(table, ["k"], "x", AT, most=20)), want)


def test_counted(table):
    rows = table.filter("k is null or k <> 'odd'")
    w = W.partitionBy("k")
    want = rows.select("k", "x", F.count(F.lit(1)).over(W.partitionBy("k", "x")).alias("c"), F.count(F.lit(1)).over(w.orderBy("x")).alias("upto"), F.count(F.lit(1)).over(w).alias("n")).distinct()
    got = selection.counted(rows, ["k"], "x", parts=16).select("k", "x", "c", "upto", "n")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
