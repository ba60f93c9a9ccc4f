"""Structured Streaming: bars, pane counts, status intervals, live books, duplicates, enrichment."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["trade_date", "symbol_index"]
#: Rows of output that a live book holds before it passes them on.
SLICE = 10_000


def stream_bars(sdf: DataFrame, freq: str = "1 minute", delay: str = "1 minute", keys: list[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Tumbling bars as they close. Empty bars can't come from a stream; add a spine downstream."""
    bars = sdf.withWatermark(ts, delay).groupBy(*keys, F.window(ts, freq)).agg(F.sum("signed_qty").alias("signed_volume"), F.sum("qty").alias("volume"), F.sum(F.when(F.col("sign") != 0, F.col("qty")).otherwise(0.0)).alias("known_volume"))
    ratio = lambda c: F.when(F.col("volume") != 0, F.col(c) / F.col("volume"))
    return bars.select(*keys, F.col("window.start").alias("bar"), "signed_volume", "volume", ratio("signed_volume").alias("imbalance"), ratio("known_volume").alias("known_ratio"))


def stream_binned_counts(sdf: DataFrame, edges: list[float], length: str = "1 hour", step: str = "30 seconds", delay: str = "1 minute", keys: list[str] = KEYS, ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts per bin in sliding windows: rows are counted into panes of one step first, and panes into windows, so a row enters one count, not all windows."""
    return _window_counts(sdf, edges, length, step, delay, keys, ts, value).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "bin", "c")


def _window_counts(sdf, edges, length, step, delay, keys, ts, value) -> DataFrame:
    bin_ = sum(((F.col(value) >= e).cast("int") for e in edges[1:]), (F.col(value) >= edges[0]).cast("int"))
    panes = sdf.withWatermark(ts, delay).groupBy(*keys, bin_.alias("bin"), F.window(ts, step)).agg(F.count(F.lit(1)).alias("c"))
    panes = panes.select(*keys, "bin", F.window_time("window").alias("at"), "c")
    return panes.groupBy(*keys, "bin", F.window("at", length, step)).agg(F.sum("c").alias("c"))


def stream_drift(sdf: DataFrame, edges: list[float], reference: DataFrame, length: str = "1 hour", step: str = "30 seconds", delay: str = "1 minute", keys: list[str] = KEYS, ts: str = "ts", value: str = "value") -> DataFrame:
    """Relative entropy of each sliding window's bins to a reference (keys, bin, q), inside the stream and in append mode.

    Panes, then windows by bin, a join with the static reference, and one more grouping by window: with c of n rows in
    a bin, the entropy is sum(c ln(c / q)) / n - ln n, so one pass of sums is enough. A bin that the reference lacks
    makes it infinite.
    """
    counts = _window_counts(sdf, edges, length, step, delay, keys, ts, value)
    rows = counts.join(reference.select(*keys, "bin", "q"), [*keys, "bin"], "left")
    term = F.when(F.coalesce("q", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("c") * F.log(F.col("c") / F.col("q")))
    out = rows.groupBy(*keys, "window").agg(F.sum("c").alias("n"), F.sum(term).alias("s"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("s") / F.col("n") - F.log("n")).alias("kl"))


def binned_kl(counts: DataFrame, reference: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Relative entropy of each window to a reference distribution (keys, bin, q): a batch step over emitted counts."""
    total = counts.groupBy(*keys, "start", "end").agg(F.sum("c").alias("n"))
    rows = counts.join(total, [*keys, "start", "end"]).join(reference, [*keys, "bin"], "left").withColumn("p", F.col("c") / F.col("n"))
    term = F.when(F.coalesce("q", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("p") * F.log(F.col("p") / F.col("q")))
    return rows.filter("c > 0").groupBy(*keys, "start", "end").agg(F.sum(term).alias("kl"))


def stream_intervals(sdf: DataFrame, state: list[str], keys: list[str] = KEYS, time: str = "event_time_ns", seq: str = "md_seq") -> DataFrame:
    """Status intervals as they close: kept per key are the open interval's start and state, and the last row's time and number.

    Rows are sorted inside each micro-batch; those at or before the last applied one are dropped, as what they would
    change has been emitted. stateful.ordered_intervals holds rows back for a delay instead.
    """
    kinds = {c: sdf.schema[c].dataType.simpleString() for c in [*keys, *state]}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "start_ns long", "end_ns long", *[f"{c} {kinds[c]}" for c in state]])
    held = ", ".join(["last long, last_seq long, start long", *[f"{c} {kinds[c]}" for c in state]])

    def run(key, frames: Iterator[pd.DataFrame], st: GroupState):
        last, open_ = (tuple(st.get[:2]), st.get[2:]) if st.exists else (None, None)
        pdf = pd.concat(list(frames)).sort_values([time, seq])
        rows = []
        for r in pdf[[time, seq, *state]].itertuples(index=False):
            if last is not None and (int(r[0]), int(r[1])) <= last:
                continue
            last, now = (int(r[0]), int(r[1])), tuple(None if pd.isna(x) else x for x in r[2:])
            if open_ is not None and tuple(None if pd.isna(x) else x for x in open_[1:]) == now:
                continue
            if open_ is not None:
                rows.append((*key, open_[0], int(r[0]), *open_[1:]))
            open_ = (int(r[0]), *now)
        if open_ is not None:
            st.update((*last, *open_))
        yield pd.DataFrame(rows, columns=[*keys, "start_ns", "end_ns", *state])

    return sdf.groupBy(*keys).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


class LiveBook:
    """One key's live orders, with quantities by price and heaps of prices. The rules are those of order_lifetimes, applied in order.

    A burst of retransmissions replaces the book; with on_retransmit "merge" its orders are put into the book that stands.
    """

    def __init__(self, orders: dict | None = None, burst: bool = False, policy: str = "display", on_retransmit: str = "reset"):
        self.policy, self.burst, self.orders, self.levels, self.heaps = policy, burst, {}, {1: {}, 2: {}}, {1: [], 2: []}
        self.resets = on_retransmit == "reset"
        for i, o in (orders or {}).items():
            self.put(int(i), *o)

    def put(self, i, side, price, qty):
        self.drop(i)
        self.orders[i] = (side, price, qty)
        level = self.levels[side]
        if price not in level:
            heapq.heappush(self.heaps[side], -price if side == 1 else price)
        level[price] = level.get(price, 0.0) + qty

    def drop(self, i):
        if i in self.orders:
            side, price, qty = self.orders.pop(i)
            left = self.levels[side][price] - qty
            if left > 1e-12:
                self.levels[side][price] = left
            else:
                del self.levels[side][price]

    def clear(self, side=None):
        for i in [i for i, o in self.orders.items() if side is None or o[0] == side]:
            self.drop(i)

    def apply(self, action, priority, prev, side, price, qty):
        if action == 5 and not self.burst and self.resets:
            self.clear()
        self.burst = action == 5
        whole = side in (1, 2) and qty is not None
        ok = whole and price is not None and price > 0
        if action == 3:
            self.clear(side)
        if action in (2, 6) and prev is not None:
            self.drop(prev)
        if action in (1, 4, 5, 6) and priority is not None:
            if ok:
                self.put(priority, side, price, qty)
            elif action == 4 and (whole or self.policy == "strict"):
                self.drop(priority)

    def best(self):
        out = []
        for side, sign in ((1, -1), (2, 1)):
            heap, level = self.heaps[side], self.levels[side]
            while heap and sign * heap[0] not in level:
                heapq.heappop(heap)
            out += [sign * heap[0], level[sign * heap[0]]] if heap else [None, None]
        return tuple(out)


def stream_book(sdf: DataFrame, keys: list[str] = KEYS, policy: str = "display", timeout: str | None = None, on_retransmit: str = "reset") -> DataFrame:
    """Best prices and quantities before and after each update, from live orders kept per key.

    Rows are sorted by seq inside each micro-batch; those at or before the last applied one are dropped, so late
    ones of an earlier batch change nothing. A burst of retransmissions replaces the book or, with on_retransmit
    "merge", is put into it. With `timeout` a key idle that long is forgotten. A key's rows of one micro-batch are held
    together, so large inputs are to come in several (see plans.queries.slices).
    """
    kinds = ", ".join(f"{k} {sdf.schema[k].dataType.simpleString()}" for k in keys)
    best = ["best_bid", "bid_depth", "best_ask", "ask_depth"]
    out = f"{kinds}, seq long, t long, action int, side int, order_type int, price double, " + ", ".join(f"{c}{s} double" for s in ("_before", "") for c in best)
    held = "last long, burst boolean, ids array<long>, sides array<int>, prices array<double>, qtys array<double>"
    columns = [*keys, "seq", "t", "action", "side", "order_type", "price", *[f"{c}_before" for c in best], *best]
    none = lambda x, f: None if pd.isna(x) else f(x)

    def run(key, frames, st: GroupState):
        if st.hasTimedOut:
            st.remove()
            return
        last, book = -1, LiveBook(policy=policy, on_retransmit=on_retransmit)
        if st.exists:
            last, burst, ids, sides, prices, qtys = st.get
            book = LiveBook(dict(zip(ids, zip(sides, prices, qtys))), burst, policy, on_retransmit)
        rows, now = [], book.best()
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            if r.seq <= last:
                continue
            before = now
            book.apply(int(r.action), none(r.priority, int), none(r.prev_priority, int), none(r.side, int), none(r.price, float), none(r.qty, float))
            rows.append((*key, r.seq, r.t, r.action, none(r.side, int), none(r.order_type, int), none(r.price, float), *before, *(now := book.best())))
            last = int(r.seq)
            if len(rows) == SLICE:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        o = book.orders
        st.update((last, book.burst, list(o), [x[0] for x in o.values()], [x[1] for x in o.values()], [x[2] for x in o.values()]))
        if timeout:
            st.setTimeoutDuration(timeout)
        yield pd.DataFrame(rows, columns=columns)

    return sdf.groupBy(*keys).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout)


def dedupe_updates(sdf: DataFrame, delay: str = "10 minutes", keys: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Each (symbol, sequence, group) once within the watermark."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys or ["symbol_index", "md_seq", "group_pos"])


def enrich(sdf: DataFrame, dims: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins with static tables (labels, session bounds) on their keys."""
    for table, on in dims:
        sdf = sdf.join(table, on, "left")
    return sdf
