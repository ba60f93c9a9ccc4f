import numpy as np
import pytest

from tidemark.operators import kde
from tidemark.operators.dominance import bands, dominance_counts, dominated, edges, sampled


def test_edges_bound_bands():
    """However often a value occurs, at most twice `most` values lie strictly between two edges."""
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=3_000), rng.integers(0, 4, 3_000).astype(float), np.r_[np.ones(2_000), rng.uniform(size=1_000)], np.ones(10)):
        pieces, most = np.array_split(x, 10), 60
        step = max(1, most // len(pieces))
        cuts = edges(np.concatenate([sampled(p, step) for p in pieces]), step, most)
        got = bands(x, cuts)
        order = np.argsort(x, kind="stable")
        assert (np.diff(got[order]) >= 0).all() and np.bincount(got)[::2].max(initial=0) <= 2 * most
        assert all(len(np.unique(x[got == b])) == 1 for b in np.unique(got) if b % 2)
    assert bands(np.array([1.0, 2.0]), np.array([])).tolist() == [0, 0]


def test_dominated_by_segments(monkeypatch):
    """Tables alone, and merged segments, of points with and without ties."""
    from tidemark.operators import dominance

    rng = np.random.default_rng(6)
    for segment in (16_384, 7, 64):
        monkeypatch.setattr(dominance, "SEGMENT", segment)
        for n in (0, 1, 2, 63, 64, 65, 400):
            for a, b in (rng.uniform(size=(2, n)), rng.integers(0, 5, (2, n)).astype(float), np.ones((2, n))):
                assert dominated(a, b).tolist() == [int(((a <= p) & (b <= q)).sum()) for p, q in zip(a, b)]


@pytest.mark.parametrize("shape", ["plain", "ties", "heavy", "same"])
def test_dominance_counts_equal_the_definition(spark, shape):
    rng = np.random.default_rng(3)
    n = 300
    a, b = rng.uniform(size=(2, n))
    if shape == "ties":
        a, b = np.round(a, 1), np.round(b, 1)
    if shape == "heavy":
        a[rng.uniform(size=n) < 0.4], b[rng.uniform(size=n) < 0.4] = 1.0, 0.0
    if shape == "same":
        a[:], b[:] = 0.5, 1.0
    cuts = [edges(sampled(x, 5), 5, 40) for x in (a, b)]
    rows = [(k, i, *map(float, p), *map(int, q)) for k in (1, 2) for i, (p, q) in enumerate(zip(zip(a, b), zip(bands(a, cuts[0]), bands(b, cuts[1]))))]
    got = dominance_counts(spark.createDataFrame(rows, "k int, t long, a double, b double, ba long, bb long"), ["k"]).collect()
    for k in (1, 2):
        want = {(p, q): int(((a <= p) & (b <= q)).sum()) for p, q in zip(a, b)}
        assert {(r["a"], r["b"]): r["count"] for r in got if r["k"] == k} == want and {(r["a"], r["b"], r["count"]) for r in got if r["k"] == k} == {(*p, c) for p, c in want.items()}
    assert dominated(a, b).tolist() == [want[p] for p in zip(a, b)]


@pytest.mark.parametrize("chunk", [50, 4])
def test_choice_over_chunks_equals_the_one_task_choice(spark, chunk):
    """Pieces shorter than the longest lag, a trend whose places are all 1, null keys, and series that are too short or constant."""
    rng = np.random.default_rng(4)
    series = {"a": rng.normal(size=260), None: np.cumsum(rng.gamma(1, size=180)), "trend": np.arange(150.0) ** 2, "few": rng.normal(size=60), "flat": np.ones(170)}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("a", 7, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(3)
    how = {"t0": 20, "nu": 6, "n_h": 2, "n_omega": 2, "grid": 64}
    read = lambda d: {(r["k"], round(r["h"], 9), round(r["omega"], 9)): r["objective"] for r in d.collect()}
    want, got = read(kde.select_kde(df, "x", ["k"], "i", **how)), read(kde.select_kde(df, "x", ["k"], "i", most=100, chunk=chunk, **how))
    assert set(got) == set(want) and {k for k, *_ in got} == {"a", None, "trend", "few"}
    assert all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)
