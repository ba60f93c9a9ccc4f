"""The unit-root test over spans against the one-task test: walks, stationary series, gaps in the order, a constant, nulls."""

import numpy as np
import pytest

from tidemark.operators import stationarity


def test_spans_equal_one_task(spark):
    rng = np.random.default_rng(5)
    n = 900
    ar = np.zeros(n)
    for i in range(3, n):
        ar[i] = 0.5 * ar[i - 1] - 0.3 * ar[i - 3] + rng.normal()
    series = {"walk": 1e4 + np.cumsum(rng.normal(size=n)), "noise": rng.normal(size=n), "ar": ar, "flat": np.full(n, 3.0), "short": rng.normal(size=40), "tiny": np.arange(5.0), None: np.cumsum(ar)}
    # gaps: spans of very different sizes, some shorter than the lags
    times = np.cumsum(np.where(rng.random(n) < 0.02, 400, rng.integers(1, 4, n)))
    rows = [(k, int(times[i]), float(v)) for k, x in series.items() for i, v in enumerate(x)] + [("noise", -5, None), ("ar", -6, float("nan"))]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(5)
    for chunk in (100, 600):
        got = {r["k"]: r for r in stationarity.adf_test(df, "x", ["k"], "t", chunk=chunk).collect()}
        assert set(got) == set(series)
        for k, x in series.items():
            want = stationarity.adf(np.asarray(x, float))
            for c in ("lags", "n"):
                assert got[k][c] == want[c], (k, c)
            for c in ("statistic", "p_value", "ljung_box_p"):
                assert got[k][c] == (want[c] if want[c] is None else pytest.approx(want[c], rel=1e-7, abs=1e-9)), (k, c)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, t long, x double")
    assert stationarity.adf_test(df, "x", ["k"], "t").count() == 0
