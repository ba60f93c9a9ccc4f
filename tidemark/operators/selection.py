"""Exact percentiles and ranks of groups of any size, without a table of a group's values in one task.

A group of more than `most` rows is narrowed in passes over the data, all groups and percentiles in each: a sketch of fixed
size gives bounds of the wanted ranks, the next pass counts what lies below and between them, and the bounds only hold if
those counts prove it. When the rest is small, its distinct values are counted and the two neighbours of the rank read off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scratch import drop, written
from . import spans

#: Rows of a group from which on its percentiles are narrowed; smaller ones keep a table of their values.
MOST = 1_000_000
#: Cells of the sketch's grid, and the sketch's accuracy: its ranks are off by at most one part in ACCURACY.
GRID, ACCURACY = 200, 10_000
#: Rows up to which a table of groups is broadcast.
SHARED = 20_000


def shared(df: DataFrame) -> DataFrame:
    """Broadcast if a bounded count allows it; else the join shuffles, and skewed partitions are split at run time."""
    return F.broadcast(df) if df.limit(SHARED + 1).count() <= SHARED else df


def group_of(keys: list[str]) -> Column:
    return F.struct(F.lit(0).alias("_"), *[F.col(k).alias(k) for k in keys])


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], most: int = MOST) -> DataFrame:
    """One row a group with the interpolated percentiles by name, as Spark's `percentile` gives them.

    Null values count for nothing, a group of nulls gives nulls, NaN is the largest value; null keys are a group.
    """
    rows = df.select(group_of(keys).alias("_g"), F.col(value).cast("double").alias("_x"))
    sizes, _ = written(rows.groupBy("_g").agg(F.count("_x").alias("_n")).filter(F.col("_n") > most), "sizes")
    plain = [F.percentile("_x", F.lit(p)).alias(c) for c, p in at.items()]
    if sizes.isEmpty():
        out = rows.groupBy("_g").agg(*plain)
    else:
        hot = shared(sizes)
        others = rows.join(hot, "_g", "left_anti").groupBy("_g").agg(*plain)
        out = others.unionByName(_narrowed(rows.filter(F.col("_x").isNotNull()).join(hot.select("_g"), "_g", "left_semi"), sizes, at, most))
    return out.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *at)


def beside(grouped: DataFrame, df: DataFrame, keys: list[str], value: str, at: dict[str, float], most: int = MOST) -> DataFrame:
    """One row a group, with its percentiles of `df` added."""
    found = percentiles(df, keys, value, at, most).select(group_of(keys).alias("_g"), *at)
    return grouped.withColumn("_g", group_of(keys)).join(found, "_g", "left").drop("_g")


def _rank(p: float) -> tuple[Column, Column, Column]:
    """Position from 0, the place before it and the place after it."""
    position = (F.col("_n") - 1) * F.lit(p)
    return position, F.floor(position), F.ceil(position)


def _between(i: int) -> Column:
    return (F.col("_x") >= F.col(f"_lo{i}")) & (F.col("_x") <= F.col(f"_hi{i}"))


def _narrowed(rows: DataFrame, sizes: DataFrame, at: dict[str, float], most: int) -> DataFrame:
    which = range(len(at))
    whole = [c for i in which for c in (F.lit(float("-inf")).alias(f"_lo{i}"), F.lit(float("nan")).alias(f"_hi{i}"))]
    state = sizes.select("_g", "_n", *whole, *[c for i in which for c in (F.lit(float("-inf")).alias(f"_oldlo{i}"), F.lit(float("nan")).alias(f"_oldhi{i}"))])
    grid = F.array(*[F.lit(j / GRID) for j in range(GRID + 1)])
    left, path = None, None
    while True:
        held = [c for c in state.columns if c != "_g"]
        counts = rows.join(shared(state), "_g").groupBy("_g").agg(*[F.first(c).alias(c) for c in held], *[a for i in which for a in (
            F.count_if(F.col("_x") < F.col(f"_lo{i}")).alias(f"_b{i}"), F.count_if(_between(i)).alias(f"_c{i}"), F.percentile_approx(F.when(_between(i), F.col("_x")), grid, ACCURACY).alias(f"_s{i}"))])
        old = path
        counts, path = written(counts, "counts")
        if old:
            drop(rows.sparkSession, old)
        proved, bounds, rest = {}, [], []
        for i, p in enumerate(at.values()):
            _, low, high = _rank(p)
            below, inside = F.col(f"_b{i}"), F.col(f"_c{i}")
            proved[i] = (below <= low) & (below + inside > high)
            slack = inside * (2 / ACCURACY) + 2
            first = F.floor((low - below - slack) / inside * GRID).cast("int")
            last = F.ceil((high - below + 1 + slack) / inside * GRID).cast("int")
            # bounds that the counts don't prove give way to those before them, which then stay
            lo = F.when(~proved[i], F.col(f"_oldlo{i}")).when(first >= 1, F.get(f"_s{i}", first)).otherwise(F.col(f"_lo{i}"))
            hi = F.when(~proved[i], F.col(f"_oldhi{i}")).when(last < GRID, F.get(f"_s{i}", last)).otherwise(F.col(f"_hi{i}"))
            bounds += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
            bounds += [F.when(proved[i], F.col(f"_{x}{i}")).otherwise(F.col(f"_old{x}{i}")).alias(f"_old{x}{i}") for x in ("lo", "hi")]
            rest.append(F.when(proved[i] & (F.col(f"_lo{i}") < F.col(f"_hi{i}")), inside).otherwise(0))
        widest = counts.agg(F.max(F.greatest(*rest, F.lit(0)))).first()[0]
        # the bounds just counted are used as they are proved; the next ones only while they promise much less
        if widest <= most or (left is not None and widest > left / 2):
            state = counts.select("_g", "_n", *[c for i in which for c in (F.when(proved[i], F.col(f"_lo{i}")).otherwise(F.col(f"_oldlo{i}")).alias(f"_lo{i}"), F.when(proved[i], F.col(f"_hi{i}")).otherwise(F.col(f"_oldhi{i}")).alias(f"_hi{i}"))])
            return _read_off(rows, state, at)
        left = widest
        state = counts.select("_g", "_n", *bounds)


def _read_off(rows: DataFrame, state: DataFrame, at: dict[str, float]) -> DataFrame:
    """The wanted ranks among the distinct values between the bounds; all below them is one row, with a null value."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("_x") <= F.col(f"_hi{i}")).alias("in"), F.when(_between(i), F.col("_x")).alias("x")) for i in range(len(at))]))
    values = rows.join(shared(state), "_g").select("_g", "_n", each.alias("e")).filter("e.in").groupBy("_g", "_n", "e.i", "e.x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("_g", "i").orderBy(F.col("x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    values = values.withColumn("upto", upto)
    aggs = []
    for i, (c, p) in enumerate(at.items()):
        position, low, high = _rank(p)
        mine = F.col("i") == i
        aggs += [F.min(F.when(mine & (F.col("upto") > low), F.col("x"))).alias(f"_v{i}"), F.min(F.when(mine & (F.col("upto") > high), F.col("x"))).alias(f"_w{i}")]
    out = values.groupBy("_g", "_n").agg(*aggs)
    for i, (c, p) in enumerate(at.items()):
        position, low, high = _rank(p)
        a, b = F.col(f"_v{i}"), F.col(f"_w{i}")
        out = out.withColumn(c, F.when(a == b, a).otherwise((low + 1 - position) * a + (position - low) * b))
    return out.select("_g", *at)


def counted(df: DataFrame, keys: list[str], value: str, aggs: list[Column] | None = None, parts: int = 256) -> DataFrame:
    """One row for each distinct value of a group: `c` rows, `upto` rows up to and with the value, `n` rows of the group.

    Values are cut at approximate quantiles of their group, so that ranks run over spans of like size; null values come first.
    """
    rows = df.select("*", group_of(keys).alias("_g"))
    cuts = rows.groupBy("_g").agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(j / parts) for j in range(1, parts)]), 4 * parts).alias("_cuts"))
    values = rows.groupBy("_g", *keys, value).agg(F.count(F.lit(1)).alias("c"), *(aggs or [])).join(shared(cuts), "_g")
    x = F.col(value).cast("double")
    # one part more for each cut that the value passes; cuts are sorted
    part = F.when(x.isNotNull(), F.coalesce(F.size(F.filter("_cuts", lambda e: e < x)), F.lit(0)))
    placed = values.withColumn("_part", part).drop("_g", "_cuts")
    return spans.running(placed, keys, ["_part", value], 1, {"upto": F.col("c")}, totals=True).withColumnRenamed("upto_total", "n").drop("_part")
