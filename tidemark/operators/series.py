"""Ordered series per key: fills, lags, returns, ranks, autocorrelation, mean reversion, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import selection


def _w(keys, order):
    return W.partitionBy(*keys).orderBy(order)


def ffill(df: DataFrame, cols: list[str], keys: list[str], order: str) -> DataFrame:
    w = _w(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def last_per_bucket(df: DataFrame, value: str, keys: list[str], bucket: str, order: str) -> DataFrame:
    """The last value of each bucket, carried over empty buckets up to the key's last."""
    from .bars import with_spine

    last = df.groupBy(*keys, bucket).agg(F.max_by(value, order).alias(value))
    return ffill(with_spine(last, bucket, keys), [value], keys, bucket).filter(F.col(value).isNotNull())


def log_returns(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("diff", F.col(value) - F.lag(value).over(_w(keys, order))).withColumn("log_return", F.log(F.col(value) / F.lag(value).over(_w(keys, order))))


def return_events(df: DataFrame, threshold: float, direction: str, value: str, keys: list[str], order: str) -> DataFrame:
    """Rows whose log return passes the threshold, with t_index, the row's number from 0 among those with a return."""
    rows = log_returns(df, value, keys, order).filter("log_return is not null")
    rows = rows.withColumn("t_index", F.row_number().over(_w(keys, order)) - 1)
    r = F.col("log_return")
    return rows.filter({"gt": r > threshold, "lt": r < threshold, "abs_gt": F.abs(r) > threshold}[direction])


def split_halves(df: DataFrame, keys: list[str], t: str = "t", integer: bool = False) -> DataFrame:
    """half 1 (t up to the midpoint) and half 2 (after it, shifted by it); T is the key's largest time."""
    top = F.max(t).over(W.partitionBy(*keys))
    mid = F.floor(top / 2) if integer else top / 2
    rows = df.withColumn("_m", mid).withColumn("half", F.when(F.col(t) <= F.col("_m"), 1).otherwise(2))
    return rows.withColumn(t, F.when(F.col("half") == 1, F.col(t)).otherwise(F.col(t) - F.col("_m"))).drop("_m")


def depth_k(df: DataFrame, k: int, prefix: str = "q") -> DataFrame:
    total = sum((F.coalesce(F.col(f"{prefix}{i}"), F.lit(0.0)) for i in range(2, k + 1)), F.coalesce(F.col(f"{prefix}1"), F.lit(0.0)))
    return df.withColumn("depth", total).withColumn("log_depth", F.log1p("depth"))


def deseasonalize(df: DataFrame, value: str, keys: list[str], season: Column) -> DataFrame:
    """Subtract the mean of a key's season (minute of the day): a window, no join."""
    return df.withColumn("_s", season).withColumn("adjusted", F.col(value) - F.avg(value).over(W.partitionBy(*keys, "_s"))).drop("_s")


def rank_uniform(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Average rank over n + 1, ties share; nulls come first. Ranks run over the distinct values of a key, by spans."""
    out = df
    for c in cols:
        rank = (F.col("upto") - F.col("c") + 1) + (F.col("c") - 1) / 2
        ranks = selection.counted(df.select(*keys, c), keys, c).select(selection.group_of([*keys, c]).alias("_g"), (rank / (F.col("n") + 1)).alias(f"{c}_u"))
        out = out.withColumn("_g", selection.group_of([*keys, c])).join(ranks, "_g").drop("_g")
    return out


def _numbered(df, keys, order, cols):
    return df.select(*keys, F.row_number().over(_w(keys, order)).alias("_i"), *cols)


def _centred(df, keys, order, pairs: dict[str, str], lags: list[int], pair) -> DataFrame:
    """Sums of products at lags: the lags are columns of one window, stacked after the grouping, so rows are not multiplied."""
    every = W.partitionBy(*keys)
    rows = df
    for new, c in pairs.items():
        rows = rows.withColumn(new, F.col(c) - F.avg(c).over(every))
    w = _w(keys, order)
    rows = rows.select(*keys, *pairs, *[pair(w, k).alias(f"p{i}") for i, k in enumerate(lags)])
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}") for c in pairs], F.array(*[F.sum(f"p{i}") for i in range(len(lags))]).alias("p"), F.array(*[F.count(f"p{i}") for i in range(len(lags))]).alias("m"))
    return sums.select("*", F.posexplode("p").alias("_k", "s")).withColumn("lag", F.element_at(F.array(*map(F.lit, lags)), F.col("_k") + 1)).withColumn("pairs", F.element_at("m", F.col("_k") + 1)).drop("p", "m", "_k")


def acf_ljung_box(df: DataFrame, value: str, nlags: int, keys: list[str], order: str) -> DataFrame:
    """lag, rho (full-sample mean, denominator n), band 1.96/sqrt(n), significant, Q up to the lag, half-life by lag 1."""
    rows = df.filter(F.col(value).isNotNull())
    out = _centred(rows, keys, order, {"_x": value}, list(range(nlags + 1)), lambda w, k: F.col("_x") * F.lag("_x", k).over(w) if k else F.col("_x") * F.col("_x"))
    out = out.withColumn("rho", F.when(F.col("ss__x") != 0, F.coalesce("s", F.lit(0.0)) / F.col("ss__x"))).withColumn("band", 1.96 / F.sqrt("n")).withColumn("significant", F.abs("rho") > F.col("band"))
    term = F.when(F.col("lag") > 0, F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag")))
    q = F.col("n") * (F.col("n") + 2) * F.sum(term).over(_w(keys, "lag").rowsBetween(W.unboundedPreceding, 0))
    first = F.max(F.when(F.col("lag") == 1, F.col("rho"))).over(W.partitionBy(*keys))
    half = F.when((first > 0) & (first < 1), F.log(F.lit(0.5)) / F.log(first))
    return out.select(*keys, "lag", "n", "rho", "band", "significant", q.alias("ljung_box_q"), half.alias("half_life"))


def with_chi_square_p(df: DataFrame, stat: str = "ljung_box_q", dof: str = "lag", to: str = "p_value") -> DataFrame:
    """Upper tail of the chi-square law; null for no degrees of freedom."""
    import pandas as pd

    from .stats import chi2_sf

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(a, b) if b > 0 and a == a else None for a, b in zip(x, k)], dtype="float64")

    return df.withColumn(to, p(F.col(stat).cast("double"), F.col(dof).cast("double")))


def xcf(df: DataFrame, d: str, v: str, max_lag: int, keys: list[str], order: str) -> DataFrame:
    """Cross-correlation at lags -max..max: full-sample means and population deviations, the mean over the overlap.

    A negative lag pairs d with an earlier... index t with v at t - lag; a positive one pairs d at t + lag with v at t.
    """
    rows = df.filter(F.col(d).isNotNull() & F.col(v).isNotNull())
    pair = lambda w, k: F.col("_d") * F.lead("_v", -k).over(w) if k < 0 else (F.lead("_d", k).over(w) * F.col("_v") if k else F.col("_d") * F.col("_v"))
    out = _centred(rows, keys, order, {"_d": d, "_v": v}, list(range(-max_lag, max_lag + 1)), pair)
    scale = F.sqrt(F.col("ss__d") / F.col("n")) * F.sqrt(F.col("ss__v") / F.col("n"))
    return out.select(*keys, "lag", F.when((scale != 0) & (F.col("pairs") > 0), F.col("s") / F.col("pairs") / scale).alias("xcf"))


def fit_mean_reversion(df: DataFrame, value: str, keys: list[str], order: str, eps: float = 1e-8) -> DataFrame:
    """a, b of the regression of the next value on this one; kappa, theta, sigma, and whether 2 kappa theta >= sigma squared."""
    w = W.partitionBy(*keys)
    rows = df.withColumn("_y", F.lead(value).over(_w(keys, order))).filter("_y is not null")
    rows = rows.withColumn("b", F.regr_slope("_y", value).over(w)).withColumn("a", F.regr_intercept("_y", value).over(w))
    resid = (F.col("_y") - F.col("a") - F.col("b") * F.col(value)) / F.sqrt(F.greatest(F.col(value), F.lit(eps)))
    out = rows.groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.stddev_samp(resid).alias("sigma"))
    out = out.withColumn("b", F.when(F.col("b") <= 0, F.lit(1e-8)).otherwise(F.col("b"))).withColumn("kappa", -F.log("b")).withColumn("theta", F.when(F.col("b") != 1, F.col("a") / (1 - F.col("b"))))
    return out.withColumn("feller", 2 * F.col("kappa") * F.col("theta") >= F.col("sigma") * F.col("sigma"))


def time_split(df: DataFrame, keys: list[str], order: str, share: float = 0.8) -> DataFrame:
    """train: the first floor(share * n) rows of each key."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("train", F.row_number().over(_w(keys, order)) <= F.floor(n * F.lit(share)))


def forecast_metrics(df: DataFrame, actual: str, forecast: str, keys: list[str], order: str) -> DataFrame:
    """Mean squared errors of levels and of log1p, the share of moves with the right sign, rows."""
    last = F.lag(actual).over(_w(keys, order))
    rows = df.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).withColumn("_l", last)
    err = F.col(actual) - F.col(forecast)
    lerr = F.log1p(F.greatest(F.col(actual), F.lit(0.0))) - F.log1p(F.greatest(F.col(forecast), F.lit(0.0)))
    hit = F.when(F.col("_l").isNotNull(), (F.signum(F.col(actual) - F.col("_l")) == F.signum(F.col(forecast) - F.col("_l"))).cast("double"))
    return rows.groupBy(*keys).agg(F.avg(err * err).alias("mse"), F.avg(lerr * lerr).alias("mse_log"), F.avg(hit).alias("sign_hit"), F.count(F.lit(1)).alias("n"))
