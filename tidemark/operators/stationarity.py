"""Unit-root test with lag choice by information criterion, and whiteness of its residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import written
from . import spans
from .hawkes import _types
from .selection import group_of, shared
from .stats import chi2_sf, normal_cdf

# Published response-surface coefficients of the p-value for a constant and one series.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P, LARGE_P = [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]


def tau_p_value(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    return normal_cdf(sum(c * tau**i for i, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P)))


def _regress(x: np.ndarray, lags: int, skip: int):
    d = np.diff(x)
    rows = np.arange(max(lags, skip), len(d))
    a = np.column_stack([x[rows], *[d[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))])
    beta, *_ = np.linalg.lstsq(a, d[rows], rcond=None)
    resid = d[rows] - a @ beta
    return a, beta, resid


def adf(x: np.ndarray, most: int = 30) -> dict:
    """Statistic, p-value, lags (least AIC on a common sample), residual whiteness over ten lags."""
    n = len(x)
    most = min(most, max(0, n // 2 - 3))
    if n < 10 or np.ptp(x) == 0:
        return {"statistic": None, "p_value": None, "lags": None, "n": n, "ljung_box_p": None}
    best = (math.inf, 0)
    for k in range(most + 1):
        a, _, r = _regress(x, k, most)
        rss = float(r @ r)
        if rss > 0:
            best = min(best, (len(r) * math.log(rss / len(r)) + 2 * a.shape[1], k))
    a, beta, r = _regress(x, best[1], best[1])
    s2 = (r @ r) / max(len(r) - a.shape[1], 1)
    tau = float(beta[0] / math.sqrt(s2 * np.linalg.pinv(a.T @ a)[0, 0]))
    # whiteness of an autoregression of the levels with as many lags
    lags = best[1]
    if lags:
        past = np.stack([x[lags - k : len(x) - k] for k in range(1, lags + 1)] + [np.ones(len(x) - lags)], 1)
        e = x[lags:] - past @ np.linalg.lstsq(past, x[lags:], rcond=None)[0]
    else:
        e = x - x.mean()
    m = min(10, max(1, len(e) // 10))
    if not e @ e > 0:
        return {"statistic": tau, "p_value": tau_p_value(tau), "lags": lags, "n": len(r), "ljung_box_p": None}
    e = e - e.mean()
    rho = np.array([e[k:] @ e[:-k] for k in range(1, m + 1)]) / (e @ e)
    q = len(e) * (len(e) + 2) * (rho**2 / (len(e) - np.arange(1, m + 1))).sum()
    return {"statistic": tau, "p_value": tau_p_value(tau), "lags": best[1], "n": len(r), "ljung_box_p": chi2_sf(q, m)}


#: Values of a series from which on it is tested over spans; and lags of the whiteness test.
CHUNK, WHITE = 200_000, 10
RESULT = "statistic double, p_value double, lags int, n long, ljung_box_p double"


def adf_test(df: DataFrame, value: str, keys: list[str], order: str, most: int = 30, chunk: int | None = None) -> DataFrame:
    """One row a key: statistic, p-value, lags, rows of the regression, residual whiteness.

    A series of more than `chunk` values (CHUNK) is never in one task: spans of its order give sums of products of its lag
    columns, from which every lag order is solved, see adf_spans(). `order` is a number without ties. Values that are null
    or NaN are left out; a series of less than ten values, or of one value, has null results.
    """
    chunk = max(chunk or CHUNK, 2 * most + 8)
    have = df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x")).withColumn("_g", group_of(keys))
    sizes = have.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_sd"), ((F.max("_o") - F.min("_o")) / F.count(F.lit(1))).cast("double").alias("_gap"))
    large, _ = written(sizes.filter(F.col("_n") > chunk), "series")

    def run(key, pdf):
        return pd.DataFrame([{**dict(zip(keys, key)), **adf(pdf.sort_values("_o")["_x"].to_numpy(float), most)}])

    def in_one(rows):
        return rows.drop("_g").groupBy(*keys).applyInPandas(run, f"{_types(df, keys)}, {RESULT}")

    if large.isEmpty():
        return in_one(have)
    hot = shared(large)
    # centred and scaled, which changes neither the statistic nor the choice of lags
    rows = have.join(hot, "_g").select("_g", "_o", ((F.col("_x") - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).alias("_z"))
    width = (large.agg(F.min("_gap")).first()[0] or 1.0) * chunk / 4
    found = adf_spans(rows, width, most).select(*[F.col(f"_g.{k}").alias(k) for k in keys], "statistic", "p_value", "lags", "n", "ljung_box_p")
    return in_one(have.join(hot, "_g", "left_anti")).unionByName(found)


def _steps(x: np.ndarray, first: int, most: int) -> np.ndarray:
    """A row for each step x[i] to x[i + 1], i >= first: level, the steps 1..most before (0 where there is none), 1, the step."""
    d = np.diff(x)
    rows = np.arange(first, len(d))
    lagged = [np.where(rows >= k, d[np.maximum(rows - k, 0)], 0.0) for k in range(1, most + 1)]
    return np.column_stack([x[rows], *lagged, np.ones(len(rows)), d[rows]])


def _solve(gram: np.ndarray, lags: int):
    """Coefficients of level, `lags` steps and constant, squared residuals, rows, and the inverse."""
    at = [*range(lags + 1), len(gram) - 2]
    inverse = np.linalg.pinv(gram[np.ix_(at, at)], hermitian=True)
    beta = inverse @ gram[at, -1]
    return beta, float(gram[-1, -1] - beta @ gram[at, -1]), int(round(gram[-2, -2])), inverse


def _choose(gram: np.ndarray, head: np.ndarray, most: int) -> dict:
    """Lags of the least criterion on the common sample, then the regression with the first steps added; and the autoregression."""
    if gram[-1, -1] == 0 and np.ptp(head) == 0:
        return {"statistic": None, "lags": None, "n": len(head) + int(round(gram[-2, -2])), "ar": None}
    best = (math.inf, 0)
    for k in range(most + 1):
        _, rss, n, _ = _solve(gram, k)
        if rss > 0:
            best = min(best, (n * math.log(rss / n) + 2 * (k + 2), k))
    lags = best[1]

    def whole(k):
        early = _steps(head, k, most)
        return _solve(gram + early.T @ early, k)

    beta, rss, n, inverse = whole(lags)
    # an autoregression of the levels with p lags is the one of the steps with p - 1
    ar = whole(lags - 1)[0].tolist() if lags else []
    return {"statistic": float(beta[0] / math.sqrt(rss / max(n - lags - 2, 1) * inverse[0, 0])), "lags": lags, "n": n, "ar": ar}


def _residuals(x: np.ndarray, begins: int, ar: list) -> tuple[np.ndarray, int]:
    """Residuals of the values at hand, and how many of them belong to the values before `begins`."""
    if not ar:
        return x, begins
    p = len(ar) - 1
    a = _steps(x, p - 1, p - 1)
    return a[:, -1] - a[:, :-1] @ np.asarray(ar), max(begins - p, 0)


def adf_spans(df: DataFrame, width: float, most: int) -> DataFrame:
    """adf() of the columns _g, _o, _z in two passes over spans of `width` of _o.

    A span holds its values and the last ones before it. The first pass gives one matrix of sums of products of the lag
    columns for it; a key's matrices are added up, and its lag orders solved from the sum. The second one takes the
    autoregression found and sums products of residuals up to ten apart.
    """
    need, side = most + WHITE + 1, most + 3
    rows = spans.cut(df, ["_g"], "_o", width)
    values = F.transform(F.sort_array(F.collect_list(F.struct("_o", "_z"))), lambda e: e["_z"]).alias("z")
    chunks = rows.groupBy(spans.SPAN).agg(values).join(spans.tails(rows, ["_g"], ["_o"], F.col("_z"), need), spans.SPAN)
    chunks, _ = written(chunks.select(F.col(f"{spans.SPAN}._g").alias("_g"), "z", "_before"), "spans")
    key = chunks.schema["_g"]

    def each(batches, names, out):
        for batch in batches:
            got = [out(*row) for row in zip(*[batch.column(n).to_pylist() for n in names])]
            kinds = {"gram": pa.list_(pa.float64()), "head": pa.list_(pa.float64()), "ar": pa.list_(pa.float64()), "sums": pa.list_(pa.float64()), "lags": pa.int32(), "n": pa.int64()}
            if got:
                yield pa.RecordBatch.from_arrays([batch.column("_g"), *[pa.array([g[c] for g in got], kinds.get(c, pa.float64())) for c in got[0]]], names=["_g", *got[0]])

    def table(text):
        return T.StructType([key, *T.StructType.fromDDL(text).fields])

    def products(z, before):
        x = np.asarray([*(before or []), *z], float)
        old = len(x) - len(z)
        a = _steps(x, max(old - 1, most), most)
        # the first values of the key, from a span that has them all
        return {"gram": (a.T @ a).ravel().tolist(), "head": x[: most + 1].tolist() if old <= most < len(x) else None}

    sums = chunks.mapInArrow(lambda b: each(b, ["z", "_before"], products), table("gram array<double>, head array<double>"))
    cells = sums.select("_g", F.posexplode("gram").alias("i", "v")).groupBy("_g", "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("_g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("gram"))
    whole = whole.join(sums.filter("head is not null").groupBy("_g").agg(F.any_value("head").alias("head")), "_g")
    fits = whole.mapInArrow(lambda b: each(b, ["gram", "head"], lambda g, h: _choose(np.reshape(g, (side, side)), np.asarray(h), most)), table("statistic double, lags int, n long, ar array<double>"))
    fits, _ = written(fits, "fits")

    def lag_sums(z, before, ar):
        old = (before or [])[-(WHITE + max(len(ar) - 1, 0)) :]
        e, first = _residuals(np.asarray([*old, *z], float), len(old), ar)
        now = np.arange(first, len(e))
        return {"sums": [float(e[now[now >= k]] @ e[now[now >= k] - k]) for k in range(WHITE + 1)] + [float(len(now))]}

    tested = chunks.join(shared(fits.filter("ar is not null").select("_g", "ar")), "_g")
    parts = tested.mapInArrow(lambda b: each(b, ["z", "_before", "ar"], lag_sums), table("sums array<double>"))
    total = parts.groupBy("_g").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(WHITE + 2)]).alias("sums"))

    def result(tau, lags, n, sums):
        white = None
        if sums and sums[0] > 0:
            size, rho = sums[-1], np.array(sums[1:-1]) / sums[0]
            white = chi2_sf(float(size * (size + 2) * (rho**2 / (size - np.arange(1, WHITE + 1))).sum()), WHITE)
        return {"statistic": tau, "p_value": None if tau is None else tau_p_value(tau), "lags": lags, "n": n, "ljung_box_p": white}

    return fits.join(total, "_g", "left").mapInArrow(lambda b: each(b, ["statistic", "lags", "n", "sums"], result), table(RESULT))
