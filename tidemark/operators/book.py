"""The order book as tables: order lifetimes, level intervals, snapshots.

An order's life is an interval between two updates of its id, or up to the next clear. Lives are found by windows
over (key, order id), and clears by windows over (key, side, run of updates), so one busy instrument spreads over tasks.
Level intervals are cumulative sums of quantity changes per (key, side, price). A snapshot is a range join of level
intervals with points of time, on equal coarse buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import KEYS

#: Numbers of updates in a run.
RUN = 65_536
#: seq orders a key's updates; t is their time. Updates carry action, priority, prev_priority, order_type, side, price, qty.


def eligible(policy: str) -> Column:
    """Whether a put may stand in the book. display and strict ask for a price above 0, include_market does not."""
    has = F.col("side").isNotNull() & F.col("qty").isNotNull()
    return has if policy == "include_market" else has & F.coalesce(F.col("price") > 0, F.lit(False))


def clears(updates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """seq, t and side (null: both) of clears: action 3, and the first of a burst of action 5 in a key's order."""
    before = F.lag("action").over(W.partitionBy(*keys).orderBy("seq"))
    burst = updates.select(*keys, "seq", "t", "action").withColumn("_b", before).filter((F.col("action") == 5) & ~F.col("_b").eqNullSafe(F.lit(5)))
    return updates.filter("action = 3").select(*keys, "seq", "t", F.col("side").cast("int").alias("side")).unionByName(burst.select(*keys, "seq", "t", F.lit(None).cast("int").alias("side")))


def touches(updates: DataFrame, keys: list[str] = KEYS, policy: str = "display") -> DataFrame:
    """Each update as what it does to order ids: a delete (sub 0) of the previous id, a put (sub 1) of its own.

    A change in place (action 4) without side or quantity is ignored under display and deletes under strict; one
    that may not stand in the book deletes.
    """
    ok = eligible(policy)
    none = F.lit(None).cast("double")

    def touch(when, order_id, sub, put):
        return F.when(when, F.struct(F.col(order_id).cast("bigint").alias("order_id"), F.lit(sub).alias("sub"), F.lit(put).alias("put"), *[(F.col(c).cast("double") if put else none).alias(c) for c in ("price", "qty")], (F.col("side").cast("int") if put else F.lit(None).cast("int")).alias("side")))

    named = F.col("priority").isNotNull()
    puts = F.col("action").isin(1, 4, 5, 6) & named
    broken = F.col("side").isNull() | F.col("qty").isNull()
    gone = (F.col("action") == 4) & named & ~ok
    if policy != "strict":
        gone = gone & ~broken
    rows = F.array_compact(F.array(touch(F.col("action").isin(2, 6) & F.col("prev_priority").isNotNull(), "prev_priority", 0, False), touch(gone, "priority", 0, False), touch(puts & ok, "priority", 1, True)))
    out = updates.select(*keys, "seq", "t", "action", "order_type", F.explode(rows).alias("x")).select(*keys, "seq", "t", "action", "order_type", "x.*")
    return out.withColumn("price", F.coalesce("price", F.lit(0.0))) if policy == "include_market" else out


def next_clear(rows: DataFrame, updates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """`rows` (keys, start, side) with _c: seq and t of the first clear of their side after `start`.

    Inside a run of updates it is the last clear seen on the way back; a row without one in its run takes the first of
    a later run, of which there is one row each.
    """
    number = F.expr(f"start div {RUN}")
    cut = clears(updates, keys).withColumn("_s", F.explode(F.when(F.col("side").isNull(), F.array(*map(F.lit, range(3)))).otherwise(F.array("side")))).select(*keys, "_s", F.col("seq").alias("start"), F.struct("seq", "t").alias("_clear")).withColumn("_run", number)
    rows = rows.withColumn("_s", F.when(F.col("side").isin(1, 2), F.col("side")).otherwise(0)).withColumn("_run", number)
    back = W.partitionBy(*keys, "_s", "_run").orderBy(F.desc("start"), F.col("_clear").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    near = rows.unionByName(cut, allowMissingColumns=True).withColumn("_c", F.last("_clear", ignorenulls=True).over(back)).filter("_clear is null").drop("_clear")
    runs = updates.select(*keys, F.expr(f"seq div {RUN}").alias("_run")).distinct().withColumn("_s", F.explode(F.array(*map(F.lit, range(3)))))
    firsts = runs.join(cut.groupBy(*keys, "_s", "_run").agg(F.min("_clear").alias("_f")), [*keys, "_s", "_run"], "left")
    later = W.partitionBy(*keys, "_s").orderBy(F.desc("_run")).rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select(*keys, "_s", "_run", F.last("_f", ignorenulls=True).over(later).alias("_later")).filter("_later is not null")
    return near.join(firsts, [*keys, "_s", "_run"], "left").withColumn("_c", F.coalesce("_c", "_later")).drop("_s", "_run", "_later")


def order_lifetimes(updates: DataFrame, keys: list[str] = KEYS, policy: str = "display", session_mode: str = "warm", start: str | None = None, end: str | None = None) -> DataFrame:
    """order_id, version, side, price, qty, start_seq, start_t, end_seq, end_t (null: still open), end_action, next_qty.

    end_action is the action of the update that ended the life, null if a clear did. session_mode "cold" leaves out
    updates outside columns `start` and `end`, so the book starts empty; "warm" applies all.
    """
    if session_mode == "cold":
        updates = updates.filter(F.col("t").between(F.col(start), F.col(end)))
    w = W.partitionBy(*keys, "order_id").orderBy("seq", "sub")
    rows = touches(updates, keys, policy)
    for c, name in (("seq", "end_seq"), ("t", "end_t"), ("action", "end_action"), ("qty", "next_qty")):
        rows = rows.withColumn(name, F.lead(c).over(w))
    rows = rows.withColumn("version", F.sum(F.col("put").cast("int")).over(w)).filter("put")
    rows = next_clear(rows.withColumnRenamed("seq", "start"), updates, keys)
    cleared = F.col("_c").isNotNull() & (F.col("end_seq").isNull() | (F.col("_c.seq") < F.col("end_seq")))
    # a clear that carries the same number as the id's next update comes first
    cleared = cleared | (F.col("_c").isNotNull() & (F.col("_c.seq") == F.col("end_seq")) & F.col("end_action").isin(3, 5))
    rows = rows.withColumn("end_action", F.when(~cleared, F.col("end_action"))).withColumn("next_qty", F.when(~cleared, F.col("next_qty")))
    rows = rows.withColumn("end_t", F.when(cleared, F.col("_c.t")).otherwise(F.col("end_t"))).withColumn("end_seq", F.when(cleared, F.col("_c.seq")).otherwise(F.col("end_seq")))
    rows = rows.filter("end_seq is null or end_seq > start")
    return rows.selectExpr(*keys, "order_id", "cast(version as int) as version", "side", "order_type", "price", "qty", "start as start_seq", "t as start_t", "end_seq", "end_t", "end_action", "next_qty", "action as start_action")


def market_buckets(updates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Running quantity of market orders without a price, by side, since the last full clear, after each of them."""
    full = clears(updates, keys).filter("side is null").select(*keys, "seq", F.lit(1).alias("clear"))
    order = W.partitionBy(*keys).orderBy("seq")
    rows = updates.join(full, [*keys, "seq"], "left").withColumn("epoch", F.count("clear").over(order))
    hit = F.col("action").isin(1, 4, 5, 6) & F.col("priority").isNotNull() & F.col("side").isNotNull() & F.col("qty").isNotNull() & ~F.coalesce(F.col("price") > 0, F.lit(False)) & (F.col("order_type") == 1)
    rows = rows.filter(hit)
    w = W.partitionBy(*keys, "epoch").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    add = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0)).over(w)
    return rows.select(*keys, "seq", add(1).alias("market_buy"), add(2).alias("market_sell"))


def level_changes(lives: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Changes of quantity and of the number of orders per (key, side, price) and update."""
    ends = F.array(F.struct(F.col("start_seq").alias("seq"), F.col("start_t").alias("t"), F.col("qty").alias("d"), F.lit(1).alias("o")), F.when(F.col("end_seq").isNotNull(), F.struct(F.col("end_seq").alias("seq"), F.col("end_t").alias("t"), (-F.col("qty")).alias("d"), F.lit(-1).alias("o"))))
    rows = lives.select(*keys, "side", "price", F.explode(F.array_compact(ends)).alias("x")).select(*keys, "side", "price", "x.*")
    return rows.groupBy(*keys, "side", "price", "seq").agg(F.min("t").alias("t"), F.sum("d").alias("d"), F.sum("o").alias("o"))


def level_intervals(lives: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """side, price, qty with the updates and times between which it holds; levels of no orders or no price are left out."""
    w = W.partitionBy(*keys, "side", "price").orderBy("seq")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = level_changes(lives, keys).select("*", F.sum("d").over(run).alias("qty"), F.sum("o").over(run).alias("orders"), F.lead("seq").over(w).alias("to_seq"), F.lead("t").over(w).alias("to_t"))
    return rows.filter("orders > 0 and qty > 0 and price > 0").select(*keys, "side", "price", "qty", F.col("seq").alias("from_seq"), F.col("t").alias("from_t"), "to_seq", "to_t")


def levels_at(intervals: DataFrame, points: DataFrame, keys: list[str] = KEYS, by: str = "t", width: int = 300_000_000) -> DataFrame:
    """Levels that hold at each point: from <= point < to. `by` is t or seq; `width` is that of the join's buckets.

    `points` has the keys and `by`. Intervals are split over the buckets that hold points of their key.
    """
    lo, hi = f"from_{by}", f"to_{by}"
    pts = points.withColumn("_b", F.expr(f"{by} div {width}"))
    span = pts.groupBy(*keys).agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"))
    cut = intervals.join(span, keys).withColumn("_x", F.greatest(F.expr(f"{lo} div {width}"), "_first")).withColumn("_y", F.least(F.coalesce(F.expr(f"{hi} div {width}"), F.col("_last")), "_last")).filter("_x <= _y")
    cut = cut.withColumn("_b", F.explode(F.sequence("_x", "_y"))).drop("_x", "_y", "_first", "_last")
    hit = (F.col(lo) <= F.col(by)) & (F.col(hi).isNull() | (F.col(by) < F.col(hi)))
    return pts.join(cut, [*keys, "_b"]).filter(hit).drop("_b", "from_seq", "to_seq", "from_t", "to_t")


def depth_cumulative(levels: DataFrame, point: list[str], max_levels: int | None = None) -> DataFrame:
    """Levels from the best outward with their rank and cumulative quantity."""
    out_price = F.when(F.col("side") == 1, -F.col("price")).otherwise(F.col("price"))
    w = W.partitionBy(*point, "side").orderBy(out_price)
    rows = levels.select("*", F.row_number().over(w).alias("level"), F.sum("qty").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cum_qty"))
    return rows.filter(F.col("level") <= max_levels) if max_levels else rows


def top_n_levels(levels: DataFrame, point: list[str], n: int = 5) -> DataFrame:
    """One row per point: bid{i}, bidvolume{i}, ask{i}, askvolume{i}, null where a level is missing."""
    ranked = depth_cumulative(levels, point, n)
    pick = lambda s, i, c: F.max(F.when((F.col("side") == s) & (F.col("level") == i), F.col(c)))
    return ranked.groupBy(*point).agg(*[pick(s, i, c).alias(f"{name}{i}") for i in range(1, n + 1) for s, c, name in ((1, "price", "bid"), (1, "qty", "bidvolume"), (2, "price", "ask"), (2, "qty", "askvolume"))])


def bbo(levels: DataFrame, point: list[str]) -> DataFrame:
    """best_bid, best_ask, their quantities (null if a side is empty), spread, mid."""
    bid, ask = F.when(F.col("side") == 1, F.col("price")), F.when(F.col("side") == 2, F.col("price"))
    out = levels.groupBy(*point).agg(F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"), F.max_by("qty", bid).alias("bid_depth"), F.min_by("qty", ask).alias("ask_depth"))
    both = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
    return out.withColumns({"bid_depth": F.when(both, F.col("bid_depth")), "ask_depth": F.when(both, F.col("ask_depth")), "spread": F.col("best_ask") - F.col("best_bid"), "mid_price": (F.col("best_ask") + F.col("best_bid")) / 2})


def imbalance(levels: DataFrame, point: list[str], n: int = 1) -> DataFrame:
    """(Vb - Va) / (Vb + Va) over the best n levels: null if a side is empty, 0 without volume."""
    r = depth_cumulative(levels, point, n).groupBy(*point).agg(F.sum(F.when(F.col("side") == 1, F.col("qty"))).alias("vb"), F.sum(F.when(F.col("side") == 2, F.col("qty"))).alias("va"))
    total = F.col("vb") + F.col("va")
    return r.select(*point, F.when(total == 0, 0.0).otherwise((F.col("vb") - F.col("va")) / total).alias("imbalance"))


def time_grid(bounds: DataFrame, step: int, keys: list[str] = KEYS) -> DataFrame:
    """Points from start to end of each row of `bounds` in steps of `step`."""
    return bounds.select(*keys, F.explode(F.sequence("start", "end", F.lit(step))).alias("t"))


def snapshots(updates: DataFrame, bounds: DataFrame, step: int, keys: list[str] = KEYS, policy: str = "display", clock: str = "asof", n: int = 5) -> DataFrame:
    """Regular snapshots in each key's session: imbalance, spread, mid and n levels a side.

    clock "asof" shows the book at the grid time. "event" shows it after the first update at or after that time, at
    most one snapshot per update, as a reader of the stream with a timer would: it falls behind across gaps.
    """
    intervals = level_intervals(order_lifetimes(updates, keys, policy), keys)
    if clock == "asof":
        points, by = time_grid(bounds, step, keys), "t"
        levels = levels_at(intervals, points, keys)
        point = [*keys, "t"]
    else:
        points, by = event_clock(updates, bounds, step, keys), "seq"
        levels = levels_at(intervals, points, keys, by="seq", width=4096)
        point = [*keys, "t", "seq"]
    # the best levels give the other columns too
    total = F.col("bidvolume1") + F.col("askvolume1")
    wide = top_n_levels(levels, point, n).withColumns({"spread": F.col("ask1") - F.col("bid1"), "mid_price": (F.col("ask1") + F.col("bid1")) / 2, "imbalance": F.when(total == 0, 0.0).otherwise((F.col("bidvolume1") - F.col("askvolume1")) / total)})
    return points.join(wide, point, "left")


def event_clock(updates: DataFrame, bounds: DataFrame, step: int, keys: list[str] = KEYS) -> DataFrame:
    """t of each scheduled snapshot and seq of the update after whose application it is taken.

    With f_k the number of in-session updates before time k, snapshot k follows update k + max over j <= k of (f_j - j).
    """
    inside = updates.join(bounds, keys).filter(F.col("t").between(F.col("start"), F.col("end"))).select(*keys, "t", "seq")
    marks = time_grid(bounds, step, keys).select(*keys, "t", F.lit(None).cast("bigint").alias("seq"))
    w = W.partitionBy(*keys).orderBy("t", F.col("seq").isNotNull(), "seq")
    rows = marks.unionByName(inside.select(*keys, "t", F.col("seq").cast("bigint").alias("seq"))).withColumn("f", F.count("seq").over(w))
    grid = rows.filter("seq is null").withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("t")) - 1)
    grid = grid.withColumn("i", F.col("k") + F.max(F.col("f") - F.col("k")).over(W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    numbered = inside.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("t", "seq")) - 1)
    return grid.select(*keys, "t", "i").join(numbered.select(*keys, "i", "seq"), [*keys, "i"]).drop("i")


def crossed_book(levels: DataFrame, point: list[str], limit: int | None = None) -> DataFrame:
    """Points whose best bid is above the best ask."""
    out = bbo(levels, point).filter("best_bid > best_ask").select(*point, "best_bid", "best_ask")
    return out.orderBy(*point).limit(limit) if limit else out


def imbalance_series(updates: DataFrame, bounds: DataFrame, step: int, keys: list[str] = KEYS, policy: str = "display") -> DataFrame:
    levels = levels_at(level_intervals(order_lifetimes(updates, keys, policy), keys), time_grid(bounds, step, keys), keys)
    return imbalance(levels, [*keys, "t"]).filter("imbalance is not null")


def decrement_events(lives: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """seq, t, side, price, kind, decrement: deletes (old quantity) and reductions in place; clears give none."""
    kind = F.when(F.col("end_action").isin(2, 6), "delete").when((F.col("end_action") == 4) & F.col("next_qty").isNull(), "delete").when((F.col("end_action") == 4) & (F.col("next_qty") < F.col("qty")), "qty_down")
    amount = F.when(F.col("next_qty").isNotNull() & (F.col("end_action") == 4), F.col("qty") - F.col("next_qty")).otherwise(F.col("qty"))
    return lives.filter("qty > 0 and price > 0").select(*keys, F.col("end_seq").alias("seq"), F.col("end_t").alias("t"), "side", "price", kind.alias("kind"), amount.alias("decrement")).filter("kind is not null")


def classify_updates(updates: DataFrame, lives: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Each update with flags: new limit order, cancel (delete, lose priority, or reduce) by the side of the order it meets.

    The order met is the life that the update ends: an equi-join on (key, order id, update).
    """
    met = lives.filter("end_action is not null").select(*keys, F.col("end_seq").alias("seq"), F.col("side").alias("_side"), F.col("qty").alias("_qty"), F.col("order_id").alias("_id"))
    at = F.when(F.col("action") == 4, F.col("priority")).otherwise(F.col("prev_priority"))
    rows = updates.withColumn("_id", at.cast("bigint")).join(met, [*keys, "seq", "_id"], "left")
    new = (F.col("action") == 1) & (F.col("order_type") == 2)
    cancel = F.col("action").isin(2, 6) | ((F.col("action") == 4) & (F.col("_qty") > F.col("qty")))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return rows.withColumns({"limit_new_bid": flag(new & (F.col("side") == 1)), "limit_new_ask": flag(new & (F.col("side") == 2)), "cancel_bid": flag(cancel & (F.col("_side") == 1)), "cancel_ask": flag(cancel & (F.col("_side") == 2))}).drop("_id", "_side", "_qty")


def log_volume_samples(updates: DataFrame, step: int, k: int, keys: list[str] = KEYS, policy: str = "display") -> DataFrame:
    """t, side, level, log_volume of the best k levels on a grid from a key's first to its last update."""
    bounds = updates.groupBy(*keys).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    levels = levels_at(level_intervals(order_lifetimes(updates, keys, policy), keys), time_grid(bounds, step, keys), keys)
    return depth_cumulative(levels, [*keys, "t"], k).select(*keys, "t", "side", "level", F.log("qty").alias("log_volume"))
