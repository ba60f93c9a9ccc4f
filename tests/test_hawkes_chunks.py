"""Fits and change tests over time chunks equal those in one task, however the chunks fall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hawkes, hawkes_chunks


@pytest.fixture(scope="module")
def events(spark):
    t, m = hawkes._simulate_sym({"mu0": 0.6, "mu1": 0.3, "alpha_self": 0.4, "alpha_cross": 0.2, "beta": 2.0}, 400.0, np.random.default_rng(2))
    rows = [("hot", float(x), int(k)) for x, k in zip(t, m)] + [("hot", float(t[50]), 1), ("hot", float(t[50]), 0)]  # equal times
    rows += [(None, float(x) / 3, int(k)) for x, k in zip(t[:300], m)] + [("few", 1.0, 0), ("few", 2.5, 1), ("few", 2.75, 1)]
    return spark.createDataFrame(rows, "k string, t double, mark int").repartition(3).cache()


@pytest.mark.parametrize("fit", ["uni", "sym", "change"])
def test_equal_to_one_task(spark, events, monkeypatch, fit):
    how = {
        "uni": lambda: hawkes.fit_hawkes_uni(events, ["k"], restarts=2),
        "sym": lambda: hawkes.fit_hawkes_sym(events, ["k"], 2.0),
        "change": lambda: hawkes.hawkes_change_test(events.filter("k = 'hot'"), ["k"], "uni"),
    }[fit]
    want = {r["k"]: r for r in how().collect()}
    monkeypatch.setattr(hawkes, "CHUNK", 120)
    calls = []
    whole = hawkes_chunks.cut_chunks
    monkeypatch.setattr(hawkes_chunks, "cut_chunks", lambda *a: (calls.append(a), whole(*a))[1])
    out = how()
    got = {r["k"]: r for r in out.collect()}
    assert calls and out.columns == list(next(iter(want.values())).__fields__) and set(got) == set(want)
    for k, row in want.items():
        for c in row.__fields__[1:]:
            assert got[k][c] == (pytest.approx(row[c], rel=1e-5, abs=1e-8) if c != "loglik" else pytest.approx(row[c], rel=1e-10)), (k, c)


def test_values_and_gradients(spark, events):
    """One evaluation over chunks of any size is the one-task likelihood to 1e-10, for all three models."""
    pdf = events.filter("k = 'hot'").toPandas().sort_values(["t", "mark"])
    t, m = pdf["t"].to_numpy(), pdf["mark"].to_numpy()
    rows = events.filter("k = 'hot'").select(F.lit(0).alias("sid"), F.lit(0).alias("part"), "t", F.col("mark").alias("m"))
    for size in (7, 150, 10**6):
        table = hawkes_chunks.cut_chunks(rows, size, len(t)).cache()
        assert table.agg(F.max("n"), F.sum("n")).first()[0:2] == (min(size, table.agg(F.max("n")).first()[0]), len(t))
        for model, beta, x in (("uni", None, [0.1, -0.7, 0.9]), ("uni", None, [0.1, -0.7, -6.0]), ("sym", 2.0, [0.0, -0.5, -1.0, -2.0]), ("sym", None, [0.0, -0.5, -1.0, -2.0, 0.3])):
            x = np.array(x)
            want = hawkes.uni_loglik(x, t, 401.0) if model == "uni" else hawkes.sym_loglik(x, t, m, 401.0, beta)
            v, g = hawkes_chunks.Chunks(table, model, beta, {(0, 0): 401.0}, 1000).values([(5, 0, (0,), x)])[5]
            assert v == pytest.approx(want[0], rel=1e-10) and np.allclose(g, want[1], rtol=1e-8, atol=1e-7)


def test_chunks_hold_all_events_in_order(spark, events):
    rows = events.select(F.when(F.col("k") == "hot", 1).otherwise(0).alias("sid"), F.lit(0).alias("part"), "t", F.col("mark").alias("m"))
    table = hawkes_chunks.cut_chunks(rows, 40, 900).collect()
    for sid in (0, 1):
        got = np.concatenate([np.frombuffer(r["t"]) for r in sorted((r for r in table if r["sid"] == sid), key=lambda r: r["chunk"])])
        assert (np.diff(got) >= 0).all() and len(got) == rows.filter(f"sid = {sid}").count()
    assert max(r["n"] for r in table) <= 40 and hawkes_chunks.cut_chunks(rows.limit(0), 40, 0).count() == 0
