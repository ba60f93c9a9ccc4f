"""Ordered windows of a hot key without its rows in one task.

A key's order is cut into spans, buckets of a fixed width of its first ordering column. Ranks, sums, last values and lags
are worked out inside spans by all tasks; one row a span meets the other spans of its key and carries what came before.
Rows are shuffled by (key, span) once, and the carried row arrives by the same partitioning. A width should leave some
ten thousand rows in the busiest span; rows of one instant stay together.

Null keys are a key of their own and a null in the first ordering column comes first, as in a plain window. The first
ordering column is a number. The given columns stay; names with an underscore in front are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPAN = "_span"
#: A width for clocks in microseconds.
HOUR = 3_600_000_000


def cut(df: DataFrame, keys: list[str], t: str, width: float) -> DataFrame:
    """Rows with the struct of their key and span. Structs compare null fields as equal, in windows and in joins."""
    return df.withColumn(SPAN, F.struct(*[F.col(k).alias(k) for k in keys], F.floor(F.col(t) / width).alias("_b")))


def _along(keys: list[str], reverse: bool = False):
    at = F.col(f"{SPAN}._b")
    return W.partitionBy(*[F.col(f"{SPAN}.{k}") for k in keys]).orderBy(at.desc() if reverse else at.asc())


def _inside(order: list[str], reverse: bool = False):
    return W.partitionBy(SPAN).orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in order])


def running(df: DataFrame, keys: list[str], order: list[str], width: float, sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """Each sum from the key's first row up to and with the row; nulls add nothing, a sum of nulls only is 0.

    `totals` adds the whole key's sum as `{name}_total`.
    """
    rows = cut(df, keys, order[0], width).withColumns(sums)
    whole = rows.groupBy(SPAN).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    along = _along(keys)
    before = along.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*[F.col(f"{SPAN}.{k}") for k in keys])
    carried = whole.select(
        SPAN, *[F.sum(f"_s_{c}").over(before).alias(f"_c_{c}") for c in sums], *([F.sum(f"_s_{c}").over(every).alias(f"{c}_total") for c in sums] if totals else [])
    )
    local = rows.select("*", *[F.sum(c).over(_inside(order).rowsBetween(W.unboundedPreceding, 0)).alias(f"_l_{c}") for c in sums])
    zero = {c: F.lit(0).cast(whole.schema[f"_s_{c}"].dataType) for c in sums}
    out = local.join(carried, SPAN).withColumns({c: F.coalesce(f"_c_{c}", zero[c]) + F.coalesce(f"_l_{c}", zero[c]) for c in sums})
    return out.drop(SPAN, *[f"{p}_{c}" for c in sums for p in ("_c", "_l")])


def numbered(df: DataFrame, keys: list[str], order: list[str], width: float, name: str = "_n", totals: bool = False) -> DataFrame:
    """The place of each row in its key's order, from 1; with `totals` the key's rows as `{name}_total`. Ties are broken by `order`."""
    return running(df, keys, order, width, {name: F.lit(1).cast("bigint")}, totals)


def last_known(df: DataFrame, keys: list[str], order: list[str], width: float, values: dict[str, Column], reverse: bool = False) -> DataFrame:
    """The last value that is not null up to and with the row (with `reverse`: the first from the row on); null without any."""
    rows = cut(df, keys, order[0], width).withColumns({f"_v_{c}": x for c, x in values.items()})
    place = F.struct(*order)
    best = F.min_by if reverse else F.max_by
    ends = rows.groupBy(SPAN).agg(*[best(F.col(f"_v_{c}"), F.when(F.col(f"_v_{c}").isNotNull(), place)).alias(f"_e_{c}") for c in values])
    before = _along(keys, reverse).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(SPAN, *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in values])
    local = _inside(order, reverse).rowsBetween(W.unboundedPreceding, 0)
    found = rows.select("*", *[F.last(f"_v_{c}", ignorenulls=True).over(local).alias(f"_l_{c}") for c in values]).join(carried, SPAN)
    return found.withColumns({c: F.coalesce(f"_l_{c}", f"_c_{c}") for c in values}).drop(SPAN, *[f"{p}_{c}" for c in values for p in ("_v", "_l", "_c")])


def tails(rows: DataFrame, keys: list[str], order: list[str], value: Column, most: int) -> DataFrame:
    """Per span the last `most` values (structs `v`) of the spans before it, in order, as `_before`; rows are cut() already.

    A frame of `most` rows back along the counts holds the spans needed and no more, at most twice `most` values.
    """
    back = F.row_number().over(W.partitionBy(SPAN).orderBy(*[F.col(c).desc() for c in order]))
    size = F.count(F.lit(1)).over(W.partitionBy(SPAN))
    kept = rows.select(SPAN, F.struct((-back).alias("i"), value.alias("v")).alias("_tail"), back.alias("_back"), size.alias("_size")).filter(F.col("_back") <= most)
    ends = kept.groupBy(SPAN).agg(F.transform(F.sort_array(F.collect_list("_tail")), lambda x: x["v"]).alias("_tail"), F.first("_size").alias("_size"))
    along = _along(keys)
    placed = ends.select(SPAN, F.lag("_tail").over(along).alias("_last"), (F.sum("_size").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size")).alias("_upto"))
    near = W.partitionBy(*[F.col(f"{SPAN}.{k}") for k in keys]).orderBy("_upto").rangeBetween(-(most - 1), 0)
    past = F.flatten(F.collect_list("_last").over(near))
    return placed.select(SPAN, F.slice(past, F.greatest(F.size(past) - most, F.lit(0)) + 1, F.lit(most)).alias("_before"))


def lagged(df: DataFrame, keys: list[str], order: list[str], width: float, value: Column, lags: dict[str, int]) -> DataFrame:
    """`value` so many rows before, by name; null where the key has no such row."""
    most = max(lags.values())
    rows = cut(df, keys, order[0], width).withColumn("_v", value)
    inside = _inside(order)
    # packed, so that a null value and a missing row are told apart by the array's length
    carried = tails(rows, keys, order, F.struct(F.col("_v").alias("x")), most)
    local = rows.select("*", F.row_number().over(inside).alias("_own"), *[F.lag("_v", k).over(inside).alias(f"_l_{c}") for c, k in lags.items()]).join(carried, SPAN)

    def past(k: int) -> Column:
        at = F.size("_before") - k + F.col("_own")
        return F.when(at >= 1, F.element_at("_before", F.greatest(at, F.lit(1)).cast("int"))["x"])

    out = local.withColumns({c: F.when(F.col("_own") > k, F.col(f"_l_{c}")).otherwise(past(k)) for c, k in lags.items()})
    return out.drop(SPAN, "_v", "_own", "_before", *[f"_l_{c}" for c in lags])
