"""Buckets, spines, and feature tables on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import KEYS
from . import selection, spans


def with_spine(df: DataFrame, bucket: str, keys: list[str] = KEYS, fill: dict | None = None) -> DataFrame:
    """Every whole bucket number between a key's first and last; missing ones get `fill` or null.

    Gaps are made from each row and its next one, so the table is shuffled once and no spine is joined.
    """
    nxt = F.lead(bucket).over(W.partitionBy(*keys).orderBy(bucket))
    rows = df.withColumn("_next", nxt)
    rows = rows.withColumn("_b", F.explode(F.sequence(F.col(bucket), F.coalesce(F.col("_next") - 1, F.col(bucket)))))
    own = F.col("_b") == F.col(bucket)
    values = [c for c in df.columns if c not in keys and c != bucket]
    return rows.select(*keys, *[F.when(own, F.col(c)).otherwise(F.lit((fill or {}).get(c))).alias(c) for c in values], F.col("_b").alias(bucket))


def bucket_time(df: DataFrame, minutes: list[int], value: str, keys: list[str], t_us: str = "t_us", spine: bool = True) -> DataFrame:
    """Mean and count for several bucket widths in one shuffle; empty buckets have a null mean and count 0."""
    rows = df.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes]))).withColumn("bucket", F.expr(f"{t_us} div (minutes * 60000000L)"))
    out = rows.groupBy(*keys, "minutes", "bucket").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return with_spine(out, "bucket", [*keys, "minutes"], {"n": 0}) if spine else out


def roll_up(fine: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """Coarser buckets from finer ones: means weigh by counts."""
    out = fine.groupBy(*keys, F.expr(f"bucket div {factor}").alias("bucket")).agg(F.sum(F.col("mean") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return out.select(*keys, "bucket", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), "n")


def bucket_events(df: DataFrame, n: int, value: str, keys: list[str], order: tuple = ("t_us", "seq"), width: float = spans.HOUR) -> DataFrame:
    """Every n events of a key: mean and count; the last bucket may be partial. Events are numbered over spans of `width`."""
    return spans.numbered(df, keys, list(order), width, "_i").groupBy(*keys, F.expr(f"(_i - 1) div {n}").alias("bucket")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def side_stats(df: DataFrame, value: str, keys: list[str], name: str, side: str = "side", approx: bool = False) -> DataFrame:
    """Per side mean, interpolated 90th percentile and count, as `{name}_{bid|ask}_{mean|p90|count}`.

    The percentile is exact, of large groups by selection.percentiles(); with `approx` it is a sketch's.
    """
    sides, aggs = {"bid": 1, "ask": 2}, []
    for label, code in sides.items():
        x = F.when(F.col(side) == code, F.col(value))
        aggs += [F.avg(x).alias(f"{name}_{label}_mean"), *([F.percentile_approx(x, 0.9).alias(f"{name}_{label}_p90")] if approx else []), F.count(x).alias(f"{name}_{label}_count")]
    out = df.groupBy(*keys).agg(*aggs)
    if approx:
        return out
    each = selection.percentiles(df.filter(F.col(side).isin(1, 2)), [*keys, side], value, {"_p": 0.9})
    found = each.groupBy(selection.group_of(keys).alias("_g")).agg(*[F.max(F.when(F.col(side) == code, F.col("_p"))).alias(f"{name}_{label}_p90") for label, code in sides.items()])
    out = out.withColumn("_g", selection.group_of(keys)).join(found, "_g", "left")
    return out.select(*keys, *[f"{name}_{label}_{c}" for label in sides for c in ("mean", "p90", "count")])


def micro_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means of spread, mid, best depths and imbalance; sums of the new-limit and cancel flags."""
    means = {"spread": "spread_mean", "mid": "mid_mean", "bid_depth": "bid_depth_mean", "ask_depth": "ask_depth_mean", "imbalance": "imbalance_ob_mean"}
    flags = {"limit_new_bid": "limit_new_bid_count", "limit_new_ask": "limit_new_ask_count", "cancel_bid": "cancel_bid_count", "cancel_ask": "cancel_ask_count"}
    return df.groupBy(*keys).agg(*[F.avg(a).alias(b) for a, b in means.items()], *[F.sum(a).alias(b) for a, b in flags.items()])


def merge_features(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge on the keys as one union and one grouping: each table has a row per key at most."""
    columns = {f.name: f.dataType for t in tables for f in t.schema.fields if f.name not in keys}
    wide = [t.select(*keys, *[F.col(c) if c in t.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()]) for t in tables]
    return reduce(DataFrame.unionByName, wide).groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])


def add_lags(df: DataFrame, cols: list[str], lags: list[int], keys: list[str], order: str = "bucket") -> DataFrame:
    """`{col}_lag{L}` by row order: a missing bucket shifts what a lag shows."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{c}_lag{n}") for c in cols for n in lags])


def causal_dataset(df: DataFrame, cols: list[str], lags: list[int], keys: list[str], order: str = "bucket") -> DataFrame:
    """Lagged features, complete cases only."""
    out = add_lags(df, [c for c in cols if c in df.columns], lags, keys, order)
    names = [c for c in out.columns if c not in keys and (c in cols or "_lag" in c)]
    return out.select(*keys, order, *names).dropna("any")


def align_series(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Inner join of two bucketed series, other columns suffixed."""
    name = lambda t, s: t.select(*on, *[F.col(c).alias(c + s) for c in t.columns if c not in on])
    return name(a, suffixes[0]).join(name(b, suffixes[1]), on)


def common_times(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_semi")


def enumerate_frequencies(text: str) -> list[int]:
    """'1,2,5,10' or '1min, 10min' as minutes."""
    return [int("".join(c for c in part if c.isdigit())) for part in text.split(",") if part.strip()]
