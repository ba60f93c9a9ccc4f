"""Best prices before and after every update.

A key is cut into chunks of time. A chunk gets the level changes inside it and, as carry-in, the levels that stand
when it begins; a kernel sweeps the changes with two heaps. Chunks are independent, so one busy instrument runs in
parallel; joins and sums around the sweep are DataFrame operations.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.columns import KEYS
from .book import classify_updates, level_changes, level_intervals, order_lifetimes

BEST = ["best_bid", "bid_depth", "best_ask", "ask_depth"]


def _sweep(seqs: list, sides: list, prices: list, changes: list) -> list[tuple]:
    """Best price and quantity a side before and after each update, of rows in the order of seq; side 0 rows are the updates themselves."""
    books: tuple = ({}, {}, {})
    heaps: tuple = ([], [], [])
    push, pop = heapq.heappush, heapq.heappop

    def best(side, sign):
        heap, book = heaps[side], books[side]
        while heap:
            price = sign * heap[0]
            if price in book:
                return price, book[price]
            pop(heap)
        return None, None

    rows, now, i, n = [], (None,) * 4, 0, len(seqs)
    while i < n:
        seq, is_update, moved = seqs[i], False, False
        while i < n and seqs[i] == seq:
            side, price = sides[i], prices[i]
            if side == 0:
                is_update = True
            else:
                moved, book = True, books[side]
                q = book.get(price, 0.0) + changes[i]
                if q > 1e-12:
                    if price not in book:
                        push(heaps[side], -price if side == 1 else price)
                    book[price] = q
                else:
                    book.pop(price, None)
            i += 1
        before = now
        if moved:
            now = (*best(1, -1), *best(2, 1))
        if is_update:
            rows.append((seq, *before, *now))
    return rows


def event_states(updates: DataFrame, keys: list[str] = KEYS, policy: str = "display", chunk: int = 86_400_000_000) -> DataFrame:
    """Each update with the best prices and their quantities before and after it, spread, mid and imbalance. `chunk` is a chunk's time."""
    lives = order_lifetimes(updates, keys, policy)
    number = lambda t: F.expr(f"{t} div {chunk}")
    marks = updates.select(*keys, number("t").alias("chunk"), F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("side"), F.lit(0.0).alias("price"), F.lit(0.0).alias("d"))
    changes = level_changes(lives, keys).filter("price > 0").select(*keys, number("t").alias("chunk"), F.col("seq").cast("bigint").alias("seq"), "side", "price", "d")
    used = marks.select(*keys, "chunk").distinct()
    span = used.groupBy(*keys).agg(F.max("chunk").alias("_last"))
    carry = level_intervals(lives, keys).join(span, keys).withColumn("_y", F.least(F.coalesce(number("to_t"), F.col("_last")), "_last")).withColumn("_x", number("from_t") + 1).filter("_x <= _y")
    carry = carry.withColumn("chunk", F.explode(F.sequence("_x", "_y"))).join(used, [*keys, "chunk"], "left_semi")
    carry = carry.select(*keys, "chunk", F.lit(-1).cast("bigint").alias("seq"), "side", "price", F.col("qty").alias("d"))
    rows = marks.unionByName(changes).unionByName(carry)
    schema = StructType([*[rows.schema[k] for k in keys], StructField("seq", LongType()), *[StructField(c, DoubleType()) for c in [*[f"{c}_before" for c in BEST], *BEST]]])

    def run(key, pdf):
        pdf = pdf.sort_values("seq", kind="stable")
        rows = _sweep(*(pdf[c].tolist() for c in ("seq", "side", "price", "d")))
        return pd.DataFrame([(*key[: len(keys)], *r) for r in rows], columns=[f.name for f in schema])

    states = rows.groupBy(*keys, "chunk").applyInPandas(run, schema)
    total = F.col("bid_depth") + F.col("ask_depth")
    out = updates.join(states, [*keys, "seq"])
    return out.withColumns({"spread": F.col("best_ask") - F.col("best_bid"), "mid_price": (F.col("best_ask") + F.col("best_bid")) / 2, "imbalance": F.when(total == 0, 0.0).otherwise((F.col("bid_depth") - F.col("ask_depth")) / total)})


def rlop_events(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distance of new limit orders behind the best price before them; both sides must be there, only positive ones count."""
    delta = F.when(F.col("side") == 1, F.col("best_bid_before") - F.col("price")).when(F.col("side") == 2, F.col("price") - F.col("best_ask_before"))
    new = states.filter("action = 1 and order_type = 2 and price is not null and best_bid_before is not null and best_ask_before is not null")
    return new.withColumn("delta", delta).filter("delta > 0").select(*keys, "seq", "t", "side", "delta", F.col("best_bid_before").alias("bid"), F.col("best_ask_before").alias("ask"), "price")


def vol_events(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """|log move| of each side's best after every update that leaves one, against the last one known; zero moves are rows."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("best_bid").alias("best")), F.struct(F.lit(2).alias("side"), F.col("best_ask").alias("best"))))
    rows = states.select(*keys, "seq", "t", side.alias("x")).select(*keys, "seq", "t", "x.*").filter("best > 0")
    last = F.lag("best").over(W.partitionBy(*keys, "side").orderBy("seq"))
    return rows.withColumn("last", last).filter("last is not null").withColumn("vol", F.abs(F.log(F.col("best") / F.col("last")))).drop("last")


def micro_events(states: DataFrame, lives: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The book before each update (spread, mid, best depths, imbalance unless a depth is 0) and what the update does."""
    out = classify_updates(states, lives, keys)
    b, a = F.col("bid_depth_before"), F.col("ask_depth_before")
    both = F.col("best_bid_before").isNotNull() & F.col("best_ask_before").isNotNull()
    return out.select(
        *keys, "seq", "t", (F.col("best_ask_before") - F.col("best_bid_before")).alias("spread"), ((F.col("best_ask_before") + F.col("best_bid_before")) / 2).alias("mid"),
        F.when(both, b).alias("bid_depth"), F.when(both, a).alias("ask_depth"), F.when(both & (b != 0) & (a != 0), (b - a) / (b + a)).alias("imbalance"),
        "limit_new_bid", "limit_new_ask", "cancel_bid", "cancel_ask",
    )
