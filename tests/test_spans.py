"""Windows over spans against plain windows of the same key: null keys, null times, ties, gaps, one span and many."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import align, spans

ROWS = [(k, t, i, v) for i, (k, t, v) in enumerate(
    [("a", t, (t * 7) % 5 if t % 3 else None) for t in (1, 2, 2, 2, 3, 9, 10, 11, 40, 41, 41, 90)] + [(None, t, 1) for t in (5, 5, 30, None)] + [("b", None, 2), ("b", 7, None), ("c", -12, 4), ("c", -1, None), ("c", 0, 6)]
)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "k string, t long, i long, v long")


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_windows_over_spans(table, width):
    plain = W.partitionBy("k").orderBy("t", "i")
    upto = plain.rowsBetween(W.unboundedPreceding, 0)
    base = table.select("k", "t", "i", "v")
    want = base.withColumns({"n": F.row_number().over(plain).cast("long"), "n_total": F.count(F.lit(1)).over(W.partitionBy("k"))})
    assert rows_of(spans.numbered(table, ["k"], ["t", "i"], width, "n", totals=True)) == rows_of(want)
    want = base.withColumn("s", F.coalesce(F.sum("v").over(upto), F.lit(0)))
    assert rows_of(spans.running(table, ["k"], ["t", "i"], width, {"s": F.col("v")})) == rows_of(want)
    want = base.withColumn("s", F.last("v", ignorenulls=True).over(upto))
    assert rows_of(spans.last_known(table, ["k"], ["t", "i"], width, {"s": F.col("v")})) == rows_of(want)
    want = base.withColumn("s", F.first("v", ignorenulls=True).over(plain.rowsBetween(0, W.unboundedFollowing)))
    assert rows_of(spans.last_known(table, ["k"], ["t", "i"], width, {"s": F.col("v")}, reverse=True)) == rows_of(want)
    lags = {"x1": 1, "x2": 2, "x7": 7, "x20": 20}
    want = base.withColumns({c: F.lag("v", k).over(plain) for c, k in lags.items()})
    assert rows_of(spans.lagged(table, ["k"], ["t", "i"], width, F.col("v"), lags)) == rows_of(want)


def test_no_rows_and_no_keys(table):
    none = table.filter("false")
    assert spans.numbered(none, ["k"], ["t", "i"], 3).count() == 0
    assert spans.lagged(none, ["k"], ["t", "i"], 3, F.col("v"), {"x": 2}).count() == 0
    alone = spans.numbered(table, [], ["t", "i"], 3, "n")
    assert sorted(r["n"] for r in alone.collect()) == list(range(1, len(ROWS) + 1))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [3, 1000])
def test_asof_over_spans(spark, table, strict, width):
    """Both directions equal the one-window forms."""
    left = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate([("a", 0), ("a", 2), ("a", 12), ("a", 95), ("c", -12), ("c", -2), ("z", 1)])], "k string, t long, n long")
    right = table.filter("v is not null and t is not null")
    for find in (align.asof_backward, align.asof_forward):
        want = find(left, right, ["k"], "t", ["v", "i"], strict=strict, tie="i")
        assert rows_of(find(left, right, ["k"], "t", ["v", "i"], strict=strict, tie="i", width=width)) == rows_of(want)


def test_window_sums_over_spans(spark, table):
    """Against a loop over all pairs; centres outside all events and of keys without events give 0."""
    events = table.filter("k is not null and t is not null and v is not null").select("k", "t", F.col("v").cast("double").alias("decrement"))
    centers = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate([("a", 1), ("a", 2), ("a", 2), ("a", 43), ("a", 200), ("c", -5), ("z", 0)])], "k string, t long, n long")
    have = events.collect()
    for width in (2, 50):
        got = align.window_sums(events, centers.drop("n"), 4, ["k"], width=width).collect()
        assert sorted((r["k"], r["t"]) for r in got) == sorted((r["k"], r["t"]) for r in centers.collect())
        for r in got:
            assert r["window_sum"] == sum(e["decrement"] for e in have if e["k"] == r["k"] and abs(e["t"] - r["t"]) <= 4)
