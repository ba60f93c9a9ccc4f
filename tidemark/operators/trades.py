"""Trades: signs, clean samples, bars by time and count, tick sizes and jumps, event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import KEYS
from . import spans

# Lower price of each band, and the tick of each of six liquidity bands.
TICK_BANDS = [
    (0.0, [0.0005, 0.0002, 0.0001, 0.0001, 0.0001, 0.0001]),
    (0.1, [0.001, 0.0005, 0.0002, 0.0001, 0.0001, 0.0001]),
    (0.2, [0.002, 0.001, 0.0005, 0.0002, 0.0001, 0.0001]),
    (0.5, [0.005, 0.002, 0.001, 0.0005, 0.0002, 0.0001]),
    (1.0, [0.01, 0.005, 0.002, 0.001, 0.0005, 0.0002]),
    (2.0, [0.02, 0.01, 0.005, 0.002, 0.001, 0.0005]),
    (5.0, [0.05, 0.02, 0.01, 0.005, 0.002, 0.001]),
    (10.0, [0.1, 0.05, 0.02, 0.01, 0.005, 0.002]),
    (20.0, [0.2, 0.1, 0.05, 0.02, 0.01, 0.005]),
    (50.0, [0.5, 0.2, 0.1, 0.05, 0.02, 0.01]),
    (100.0, [1.0, 0.5, 0.2, 0.1, 0.05, 0.02]),
    (200.0, [2.0, 1.0, 0.5, 0.2, 0.1, 0.05]),
    (500.0, [5.0, 2.0, 1.0, 0.5, 0.2, 0.1]),
    (1000.0, [10.0, 5.0, 2.0, 1.0, 0.5, 0.2]),
    (2000.0, [20.0, 10.0, 5.0, 2.0, 1.0, 0.5]),
    (5000.0, [50.0, 20.0, 10.0, 5.0, 2.0, 1.0]),
    (10000.0, [100.0, 50.0, 20.0, 10.0, 5.0, 2.0]),
    (20000.0, [200.0, 100.0, 50.0, 20.0, 10.0, 5.0]),
    (50000.0, [500.0, 200.0, 100.0, 50.0, 20.0, 10.0]),
]


def with_trade_sign(df: DataFrame, flags: str = "qualifier", qty: str = "qty") -> DataFrame:
    """Add the eight qualifier flags' aggressor sign and signed_qty.

    `flags` is the nested field `[1,{b1,..,b8}]`. +1 for an aggressive buy, else -1 for a passive buy, else 0.
    """
    bits = F.split(F.regexp_extract(F.col(flags), r"\{([^}]*)\}", 1), ",")
    bit = lambda i: F.try_element_at(bits, F.lit(i)).try_cast("int")
    sign = F.when(bit(4) == 1, 1).when(bit(3) == 1, -1).otherwise(0)
    return df.withColumn("sign", sign).withColumn("signed_qty", F.col("sign") * F.coalesce(F.col(qty), F.lit(0.0)))


def clean_trades(df: DataFrame, venue: str | None = None, mechanism: str = "mechanism", mode: str = "mode") -> DataFrame:
    """Central book, continuous mode, known side."""
    out = df.filter((F.col(mechanism) == 1) & (F.col(mode) == "2") & F.col("sign").isin(1, -1))
    return out.filter(F.col("venue") == venue) if venue else out


def tick_size(price: Column, band: int) -> Column:
    """Tick of a price in liquidity band 1 to 6; null for null or negative prices. A bad band is an error."""
    if band not in range(1, 7):
        raise ValueError(f"liquidity band {band}: it goes from 1 to 6")
    out = F.lit(None).cast("double")
    for low, ticks in TICK_BANDS:
        out = F.when(price >= low, ticks[band - 1]).otherwise(out)
    return out


def with_tick_size(df: DataFrame, band: int, price: str = "price") -> DataFrame:
    """The range lookup as one expression: nineteen rows need no join."""
    return df.withColumn("tick", tick_size(F.col(price), band))


def tick_jumps(trades: DataFrame, band: int, keys: list[str] = KEYS, order: tuple = ("t_us", "seq")) -> DataFrame:
    """Price changes of continuous trades in ticks of the price before, rounded half to even; the first trade has none."""
    last = F.lag("price").over(W.partitionBy(*keys).orderBy(*order))
    out = trades.filter(F.col("mode") == "2").withColumn("prev_price", last)
    return out.withColumn("jump", F.rint((F.col("price") - F.col("prev_price")) / tick_size(F.col("prev_price"), band)).cast("int")).filter("jump is not null")


def tick_histogram(jumps: DataFrame, max_abs: int = 50, keys: list[str] = KEYS) -> DataFrame:
    return jumps.filter(F.col("jump").between(-max_abs, max_abs)).groupBy(*keys, "jump").agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def trade_flow(df: DataFrame, bucket: str = "bucket", keys: list[str] = KEYS) -> DataFrame:
    """Per bucket: trades, volume, signed and absolute signed volume, their imbalance (null without signed volume)."""
    out = df.groupBy(*keys, bucket).agg(F.count("price").alias("trade_count"), F.sum("qty").alias("trade_volume"), F.sum("signed_qty").alias("signed_volume"), F.sum(F.abs("signed_qty")).alias("abs_signed_volume"))
    return out.withColumn("imb_of", _ratio(F.col("signed_volume"), F.col("abs_signed_volume")))


def time_bars(trades: DataFrame, minutes: int = 1, keys: list[str] = KEYS, t_us: str = "t_us", spine: bool = True) -> DataFrame:
    """Bars of a key's trades with empty ones kept between its first and last: signed, total and known volume, imbalance, known ratio."""
    width = minutes * 60_000_000
    known = F.when(F.col("sign") != 0, F.col("qty")).otherwise(0.0)
    bars = trades.withColumn("bar", F.expr(f"{t_us} div {width}")).groupBy(*keys, "bar").agg(F.sum("signed_qty").alias("signed_volume"), F.sum("qty").alias("volume"), F.sum(known).alias("known_volume"))
    if spine:
        from .bars import with_spine

        bars = with_spine(bars, "bar", keys, fill={"signed_volume": 0.0, "volume": 0.0, "known_volume": 0.0})
    return bars.withColumn("bar_us", F.col("bar") * width).withColumn("imbalance", _ratio(F.col("signed_volume"), F.col("volume"))).withColumn("known_ratio", _ratio(F.col("known_volume"), F.col("volume")))


def count_bars(trades: DataFrame, n: int, keys: list[str] = KEYS, order: tuple = ("t_us", "seq"), width: float = spans.HOUR) -> DataFrame:
    """Blocks of exactly n trades; a remainder is left out. Keys with no full block give no rows. Trades are numbered over spans of `width`."""
    rows = spans.numbered(trades, keys, list(order), width, "_i", totals=True)
    rows = rows.withColumn("block", F.expr(f"(_i - 1) div {n}")).filter(F.col("block") < F.expr(f"_i_total div {n}"))
    known = F.when(F.col("sign") != 0, F.col("qty")).otherwise(0.0)
    out = rows.groupBy(*keys, "block").agg(
        F.sum("signed_qty").alias("signed_volume"), F.sum("qty").alias("volume"), F.sum(known).alias("known_volume"),
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.max_by("price", "_i").alias("last_price"),
    )
    return out.withColumn("imbalance", _ratio(F.col("signed_volume"), F.col("volume"))).withColumn("known_ratio", _ratio(F.col("known_volume"), F.col("volume")))


def trade_counts(trades: DataFrame, minutes: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Trades per bucket and side, with zero for empty buckets between a key's first and last."""
    from .bars import with_spine

    width = minutes * 60_000_000
    counts = trades.withColumn("bar", F.expr(f"t_us div {width}")).groupBy(*keys, "bar").agg(F.count_if(F.col("sign") > 0).alias("buys"), F.count_if(F.col("sign") < 0).alias("sells"))
    return with_spine(counts, "bar", keys, fill={"buys": 0, "sells": 0})


def event_seconds(trades: DataFrame, eps: float = 1e-6, keys: list[str] = KEYS, seq: str = "seq") -> DataFrame:
    """Seconds since the key's first trade of either side; equal stamps of a side are set eps apart in sequence order."""
    tie = F.row_number().over(W.partitionBy(*keys, "sign", "t_us").orderBy(seq)) - 1
    first = trades.groupBy(*keys).agg(F.min("t_us").alias("_first"))
    # one row a key, joined on keys of which none is lost, null ones included
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = trades.alias("a").join(first.alias("b"), same).select("a.*", ((F.col("t_us") - F.col("_first")) / 1e6).alias("t_seconds"))
    return out.withColumn("t_seconds_jitter", F.col("t_seconds") + F.lit(eps) * tie)


def merge_marked(buy: DataFrame, sell: DataFrame) -> DataFrame:
    """One stream with mark 0 for buys and 1 for sells."""
    return buy.withColumn("mark", F.lit(0)).unionByName(sell.withColumn("mark", F.lit(1)))


def split_sides(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    return trades.filter("sign = 1"), trades.filter("sign = -1")
