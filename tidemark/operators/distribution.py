"""Samples per group: descriptions, histograms, distribution functions, gamma fits and goodness of fit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import selection
from .entropy import equal_width_bin

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def log_volume(df: DataFrame, volume: str = "volume") -> DataFrame:
    return df.filter(F.col(volume) > 0).withColumn("log_volume", F.log(volume))


def describe_side(df: DataFrame, value: str, keys: list[str], side: str = "side") -> DataFrame:
    """Per side and for both together (side null): size, moments (population), extremes and quartiles, by grouping sets.

    Quartiles of large groups come from selection.percentiles(). A null side is a side of its own.
    """
    x = F.col(value)
    sets = [[*keys, side], keys] if keys else [[side], []]
    have = df.filter(x.isNotNull())
    rows = have.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, side]])
    rows = rows.agg(F.grouping(side).alias("_both"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("min"), F.max(x).alias("max"))
    each = selection.percentiles(have, [*keys, side], value, QUARTILES).withColumn("_both", F.lit(0).cast("tinyint"))
    both = selection.percentiles(have, keys, value, QUARTILES).select(*keys, F.lit(None).cast(df.schema[side].dataType).alias(side), *QUARTILES, F.lit(1).cast("tinyint").alias("_both"))
    group = selection.group_of([*keys, side, "_both"])
    found = each.unionByName(both).select(group.alias("_g"), *QUARTILES)
    return rows.withColumn("_g", group).join(found, "_g", "left").select(*keys, side, "n", "mean", "std", "skew", "kurtosis", "min", *QUARTILES, "max")


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: count, mean, sample deviation, extremes, quartiles; the columns are stacked, the table read once."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select("s.*")
    out = rows.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return selection.beside(out, rows, ["column"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def hour_histogram(df: DataFrame, value: str, hour, edges: int = 100) -> DataFrame:
    """Counts in equal bins over the whole range, by hour and for the day (hour null)."""
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    rows = df.join(F.broadcast(span))  # one row on the right
    rows = rows.filter(F.col(value).isNotNull()).select(hour.alias("hour"), equal_width_bin(F.col(value), F.col("low"), F.col("high"), edges - 1).alias("bin"))
    return rows.groupingSets([[F.col("hour"), F.col("bin")], [F.col("bin")]], F.col("hour"), F.col("bin")).agg(F.count(F.lit(1)).alias("n"))


def density_histogram(df: DataFrame, value: str, keys: list[str], bins: int = 100) -> DataFrame:
    """Equal bins over each group's range: count and density."""
    every = W.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_low": F.min(value).over(every), "_high": F.max(value).over(every), "_n": F.count(F.lit(1)).over(every)})
    rows = rows.withColumn("bin", equal_width_bin(F.col(value), F.col("_low"), F.col("_high"), bins))
    out = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_n").alias("_n"), F.first("_low").alias("low"), F.first("_high").alias("high"))
    return out.withColumn("density", F.when(F.col("high") > F.col("low"), F.col("n") * bins / (F.col("_n") * (F.col("high") - F.col("low"))))).drop("_n")


def ecdf(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys)
    return df.filter(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) / F.count(F.lit(1)).over(w)).alias("ecdf"))


def top_values(df: DataFrame, value: str, keys: list[str], n: int = 8) -> DataFrame:
    """The n most frequent values of each group; the smaller one first on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def drop_top_values(df: DataFrame, value: str, keys: list[str], n: int = 8) -> DataFrame:
    """All rows but those of the n most frequent values. The list has n rows a group."""
    return df.join(top_values(df, value, keys, n).select(*keys, value), [*keys, value], "left_anti")


def gamma_input(df: DataFrame, log_value: str, keys: list[str], threshold: float = 0.1) -> DataFrame:
    """x to fit: positive log-volumes, or raw volumes where more than `threshold` of the log-volumes are negative."""
    share = F.avg((F.col(log_value) < 0).cast("double")).over(W.partitionBy(*keys))
    rows = df.filter(F.col(log_value).isNotNull()).withColumn("negative_share", share)
    raw = F.col("negative_share") > threshold
    return rows.withColumn("x", F.when(raw, F.exp(log_value)).when(F.col(log_value) > 0, F.col(log_value))).withColumn("input", F.when(raw, "volume").otherwise("log_volume")).filter("x > 0")


def fit_gamma(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Maximum likelihood with location 0: n, mean, mean of logs by grouping, then one equation a group."""
    stats = df.filter(F.col(value) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(F.log(value)).alias("mean_log"))

    @F.pandas_udf("double")
    def shape(gap: pd.Series) -> pd.Series:
        from .stats import gamma_shape

        return pd.Series([gamma_shape(g) if g == g else None for g in gap], dtype="float64")

    out = stats.withColumn("shape", shape(F.log("mean") - F.col("mean_log")))
    return out.withColumn("scale", F.col("mean") / F.col("shape"))


def fitted_cdf(df: DataFrame, fits: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """`cdf` of each value under its group's gamma fit."""

    @F.pandas_udf("double")
    def cdf(x: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
        from .stats import gamma_p

        return pd.Series([gamma_p(b, a / c) if a == a and b == b else None for a, b, c in zip(x, k, s)], dtype="float64")

    return df.join(fits.select(*keys, "shape", "scale"), keys).withColumn("cdf", cdf(F.col(value).cast("double"), "shape", "scale")).drop("shape", "scale")


def ks_stat(df: DataFrame, value: str, cdf, keys: list[str]) -> DataFrame:
    """Largest gap of the empirical and a given distribution function (a column), and rows; equal values are one step."""
    rows = selection.counted(df.filter(F.col(value).isNotNull()).withColumn("_f", cdf), keys, value, [F.min("_f").alias("_low"), F.max("_f").alias("_high")])
    gap = F.greatest(F.col("upto") / F.col("n") - F.col("_low"), F.col("_high") - (F.col("upto") - F.col("c")) / F.col("n"))
    return rows.groupBy(*keys).agg(F.max(gap).alias("ks"), F.first("n").alias("n"))


def with_ks_p(df: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series) -> pd.Series:
        from .stats import ks_p_value

        return pd.Series([ks_p_value(a, int(b)) for a, b in zip(d, n)], dtype="float64")

    return df.withColumn("p_value", p("ks", F.col("n").cast("double")))


def with_chi2_p(df: DataFrame, statistic: str, dof: str) -> DataFrame:
    """`p_value`, the chi-square tail of a statistic by degrees of freedom; null where either is null. For rows of tests, not of data."""

    @F.pandas_udf("double")
    def p(x: pd.Series, k: pd.Series) -> pd.Series:
        from .stats import chi2_sf

        return pd.Series([chi2_sf(a, b) if a == a and b == b else None for a, b in zip(x, k)], dtype="float64")

    return df.withColumn("p_value", p(F.col(statistic).cast("double"), F.col(dof).cast("double")))


def fitted_curve(fits: DataFrame, low: str, high: str, keys: list[str], n: int = 500) -> DataFrame:
    """x and density on n points between two columns of each fit."""
    rows = fits.select(*keys, "shape", "scale", low, high, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    rows = rows.withColumn("x", F.col(low) + (F.col(high) - F.col(low)) * F.col("i") / (n - 1))

    @F.pandas_udf("double")
    def pdf(x: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
        import math

        return pd.Series([math.exp((b - 1) * math.log(a) - a / c - math.lgamma(b) - b * math.log(c)) if a > 0 else 0.0 for a, b, c in zip(x, k, s)])

    return rows.select(*keys, "i", "x", pdf("x", "shape", "scale").alias("density"))


def compare_sides(fits: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """Ratios of side 1's to side 2's fitted shape and scale, with labels at 0.9 and 1.1."""
    pick = lambda c, s: F.max(F.when(F.col(side) == s, F.col(c)))
    out = fits.groupBy(*keys).agg((pick("shape", 1) / pick("shape", 2)).alias("shape_ratio"), (pick("scale", 1) / pick("scale", 2)).alias("scale_ratio"))
    label = lambda c: F.when(F.col(c) > 1.1, "larger").when(F.col(c) < 0.9, "smaller").when(F.col(c).isNotNull(), "similar")
    return out.withColumns({"shape_class": label("shape_ratio"), "scale_class": label("scale_ratio")})


def qq_table(df: DataFrame, value: str, dist: str, keys: list[str]) -> DataFrame:
    """Sorted values with plotting positions (i - 0.5) / n and theoretical quantiles: exp (rate 1), uniform, or normal."""
    w = W.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("sample"), F.row_number().over(w.orderBy(value)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    rows = rows.withColumn("p", (F.col("i") - 0.5) / F.col("n"))
    if dist == "exp":
        return rows.withColumn("theoretical", -F.log(1 - F.col("p")))
    if dist == "uniform":
        return rows.withColumn("theoretical", F.col("p"))

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        from .stats import normal_quantile

        return pd.Series([normal_quantile(x) for x in p])

    return rows.withColumn("theoretical", quantile("p"))


def time_range(df: DataFrame, t: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))


def sample_per_group(df: DataFrame, col: str, n: int, id_cols: list[str], seed: int = 0) -> DataFrame:
    """Up to n rows of each group, those of the least MD5 of seed and ids: the same on every run. Large groups keep n rows a task before they meet."""
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))
    rank = F.row_number().over(W.partitionBy(col).orderBy(place, *id_cols))
    return df.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
