"""Events against centres: window sums, as-of joins, context rows, alignment statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scratch import written
from . import selection, spans


def _asof(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], forward: bool, strict: bool = False, tie: str | None = None, width: float | None = None) -> DataFrame:
    """Union of both sides and one ordered window, over spans of `width` where it is given: no range join, no fan-out. Left rows keep their columns."""
    cols = [c for c in left.columns if c not in keys and c != t]
    a = left.select(*keys, t, F.lit(1).alias("_left"), *cols, *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"))
    b = right.select(*keys, t, F.lit(0).alias("_left"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], *[F.col(v).alias(f"_{v}") for v in values], (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"))
    # a right row at the same time is met unless the match is strict
    first_right = forward == strict
    found = F.struct(*[F.col(f"_{v}").alias(v) for v in values])
    if width is not None:
        both = a.unionByName(b).withColumn("_side", F.col("_left") if first_right else -F.col("_left"))
        rows = spans.last_known(both, keys, [t, "_side", "_tie"], width, {"_m": F.when(F.col("_left") == 0, found)}, reverse=forward)
        return rows.filter("_left = 1").select(*left.columns, *[F.col(f"_m.{v}").alias(v) for v in values])
    side = F.col("_left").asc() if first_right else F.col("_left").desc()
    order = [F.col(t).asc(), side, F.col("_tie").asc()]
    if forward:
        # the same frame over the reversed order, as one that ends with the partition is computed anew for each row
        order = [F.col(t).desc(), F.col("_left").desc() if first_right else F.col("_left").asc(), F.col("_tie").desc()]
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_m", F.last(F.when(F.col("_left") == 0, found), ignorenulls=True).over(frame))
    return rows.filter("_left = 1").select(*left.columns, *[F.col(f"_m.{v}").alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], strict: bool = False, tie: str | None = None, width: float | None = None) -> DataFrame:
    """The latest right row at or before (strict: before) each left row. With `width` a key's rows are spread over spans, see spans.py."""
    return _asof(left, right, keys, t, values, forward=False, strict=strict, tie=tie, width=width)


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], strict: bool = False, tie: str | None = None, width: float | None = None) -> DataFrame:
    """The first right row at or after (strict: after) each left row. With `width` a key's rows are spread over spans, see spans.py."""
    return _asof(left, right, keys, t, values, forward=True, strict=strict, tie=tie, width=width)


def window_sums(events: DataFrame, centers: DataFrame, w: int, keys: list[str], t: str = "t", value: str = "decrement", width: float | None = None) -> DataFrame:
    """Sum of events in [t - w, t + w] of each centre, 0 without any or without a time.

    A centre is two rows among the events, before those at t - w and after those at t + w; its sum is the difference of the
    running sum at both, which goes over spans of `width`, 32 w if not given. `centers` has the keys, t, and other columns
    that can be grouped by; equal centres stay as many as they are.
    """
    have = events.filter(F.col(t).isNotNull()).select(*keys, t, F.lit(1).alias("_side"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(centers.schema).alias("_c"))
    ends = F.explode(F.array(*[F.struct((F.col(t) + d).alias("at"), F.lit(side).alias("side")) for d, side in ((-w, 0), (w, 2))]))
    asked = centers.select(*keys, ends.alias("_e"), F.struct(*centers.columns).alias("_c")).select(*keys, F.col("_e.at").alias(t), F.col("_e.side").alias("_side"), F.lit(None).cast("double").alias("_v"), "_c")
    sums = spans.running(have.unionByName(asked), keys, [t, "_side"], width or 32 * w, {"_total": F.col("_v")}).filter("_side <> 1")
    signed = F.when(F.col("_side") == 2, F.col("_total")).otherwise(-F.col("_total"))
    each = sums.groupBy("_c").agg(F.sum(signed).alias("_s"), F.count_if(F.col("_side") == 2).alias("_m"))
    return each.withColumn("window_sum", F.col("_s") / F.col("_m")).withColumn("_m", F.explode(F.sequence(F.lit(1).cast("bigint"), "_m"))).select("_c.*", "window_sum")


def _numbered(events: DataFrame, w: int, keys: list[str], t: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Events with their place in their key's order (_n, from 1), ranked inside buckets of width w; and each bucket's events up to its end."""
    rows = events.withColumn("_b", F.floor(F.col(t) / w))
    total = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size")).select(*keys, "_b", F.sum("_size").over(W.partitionBy(*keys).orderBy("_b")).alias("_upto"), "_size")
    own = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(t, order))
    placed = rows.withColumn("_own", own).join(total, [*keys, "_b"]).withColumn("_n", F.col("_upto") - F.col("_size") + F.col("_own"))
    return placed.drop("_upto", "_size"), total.select(*keys, "_b", "_upto")


def window_context(events: DataFrame, centers: DataFrame, w: int, keys: list[str], t: str = "t", per: int = 25, center_id: str = "center", order: str = "seq") -> DataFrame:
    """The first `per` events in each centre's window, ranked from 1, with their offset in time.

    Events are numbered by (t, order) in each key. A centre looks up how many lie before its window and asks for the
    next `per` numbers by an equal join, so a window of many events costs no more than one of `per`. Rank and look-up
    go by buckets of width w; only one row a bucket meets in one task of a key. Centres or events without keys or time
    are in no window.
    """
    placed, total = _numbered(events.filter(F.col(t).isNotNull()), w, keys, t, order)
    c = centers.filter(F.col(t).isNotNull()).select(*keys, center_id, F.col(t).alias("_c"), (F.col(t) - w).alias("_low")).withColumn("_b", F.floor(F.col("_low") / w))
    # events of earlier buckets, then those of the bucket in which the window begins
    buckets = asof_backward(c.select(*keys, "_b").distinct(), total, keys, "_b", ["_upto"], strict=True)
    inside = asof_backward(c.withColumnRenamed("_low", t), placed.select(*keys, "_b", t, "_own"), [*keys, "_b"], t, ["_own"], strict=True, tie="_own")
    begins = inside.join(buckets, [*keys, "_b"]).select(*keys, center_id, "_c", (F.coalesce("_upto", F.lit(0)) + F.coalesce("_own", F.lit(0))).alias("_before"))
    wanted = begins.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(per)))).withColumn("_n", F.col("_before") + F.col("rank"))
    rows = wanted.join(placed.drop("_b", "_own"), [*keys, "_n"]).filter(F.col(t) <= F.col("_c") + w)
    return rows.withColumn("offset", F.col(t) - F.col("_c")).drop("_c", "_n", "_before")


def alignment_stats(sums: DataFrame, value: str = "window_sum", by: list[str] | None = None) -> DataFrame:
    """Size, mean, exact percentiles and share of zeros; large groups by selection.percentiles()."""
    x = F.col(value)
    sums, _ = written(sums.select(*(by or []), value), "sums")  # read several times
    rows = sums.groupBy(*(by or [])).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((x == 0).cast("double")).alias("share_zero"))
    rows = selection.beside(rows, sums, by or [], value, {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return rows.select(*(by or []), "n", "mean", "median", "p90", "p99", "share_zero")


def random_centers(bounds: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n seeded uniform centres a key between `start` and `end`; the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), *keys, "center"), F.lit(1_000_003)) / 1_000_003
    return bounds.withColumn("center", F.explode(F.sequence(F.lit(1), F.lit(n)))).select(*keys, "center", (F.col("start") + F.floor((F.col("end") - F.col("start")) * u)).cast("bigint").alias("t"))
