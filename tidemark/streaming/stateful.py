"""Stateful streams whose state is written by change: ordered status intervals and live books.

Both run on transformWithStateInPandas, so the session's state store must be the one that holds maps and timers
(`spark.sql.streaming.stateStore.providerClass` = ROCKSDB). What a batch writes is what it changed: an order, a price
level, a held row, one head row a key.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import book_events
from .jobs import KEYS, SLICE, LiveBook

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
BEST = ["best_bid", "bid_depth", "best_ask", "ask_depth"]


def _none(x, kind=lambda y: y):
    return None if pd.isna(x) else kind(x)


class OrderedIntervals(StatefulProcessor):
    """Rows wait until the watermark has passed them, then close and open intervals in the order of (time, seq)."""

    def __init__(self, keys: list[str], state: list[str], kinds: dict[str, str], time: str, seq: str):
        self.keys, self.columns, self.time, self.seq = keys, state, time, seq
        self.kinds = ", ".join(f"{c} {kinds[c]}" for c in state)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", f"start long, {self.kinds}")
        self.held = handle.getMapState("held", "time long, seq long", self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for r in pdf[[self.time, self.seq, *self.columns]].itertuples(index=False):
                self.held.updateValue((int(r[0]), int(r[1])), tuple(_none(x) for x in r[2:]))
                first = int(r[0]) if first is None else min(first, int(r[0]))
        if first is not None:
            self.handle.registerTimer(first // 1_000_000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted(((tuple(k), tuple(v)) for k, v in self.held.iterator()), key=lambda x: x[0])
        ready = [x for x in waiting if x[0][0] // 1_000_000 <= until]
        if len(ready) < len(waiting):
            self.handle.registerTimer(waiting[len(ready)][0][0] // 1_000_000)
        held = self.open.get() if self.open.exists() else None
        now = None if held is None else (int(held[0]), *(_none(x) for x in held[1:]))
        out = []
        for (time, seq), values in ready:
            values = tuple(_none(x) for x in values)
            self.held.removeKey((time, seq))
            if now is not None and now[1:] == values:
                continue
            if now is not None:
                out.append((*key, now[0], time, *now[1:]))
            now = (time, *values)
        if now is not None:
            self.open.update(now)
        yield pd.DataFrame(out, columns=[*self.keys, "start_ns", "end_ns", *self.columns])

    def close(self) -> None:
        pass


def ordered_intervals(sdf: DataFrame, state: list[str], delay: str, keys: list[str] = KEYS, time: str = "event_time_ns", seq: str = "md_seq") -> DataFrame:
    """Status intervals as they close, by rows that may come late by `delay` and in any order.

    A row counts once the watermark (the latest time seen less `delay`) has passed it; rows that come after that are
    dropped. The same rows give the same intervals however they are delivered, apart from those later than `delay`.
    """
    kinds = {c: sdf.schema[c].dataType.simpleString() for c in [*keys, *state]}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "start_ns long", "end_ns long", *[f"{c} {kinds[c]}" for c in state]])
    rows = sdf.withColumn("_ts", F.timestamp_micros(F.expr(f"{time} div 1000"))).withWatermark("_ts", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(OrderedIntervals(keys, state, kinds, time, seq), out, "append", "EventTime")


class StoredBook(LiveBook):
    """A live book whose orders are fetched one by one as updates name them; save() writes what has changed."""

    def __init__(self, orders, levels, fresh: bool, burst: bool, policy: str, on_retransmit: str):
        super().__init__({}, burst, policy, on_retransmit)
        self.stored, self.stored_levels, self.fresh, self.whole = orders, levels, fresh, fresh
        self.were: dict[int, tuple | None] = {}
        self.levels_were: dict[tuple[int, float], float] = {}
        if not fresh:
            for (side, price), (qty,) in levels.iterator():
                self.levels[side][price] = self.levels_were[side, price] = qty
                heapq.heappush(self.heaps[side], -price if side == 1 else price)

    def _fetch(self, i: int, value=None) -> None:
        if i not in self.were:
            value = value if value is not None or self.whole else self.stored.getValue((i,))
            self.were[i] = tuple(value) if value is not None else None
            if value is not None:
                self.orders[i] = tuple(value)

    def drop(self, i):
        self._fetch(i)
        super().drop(i)

    def clear(self, side=None):
        if not self.whole:
            for (i,), value in list(self.stored.iterator()):
                self._fetch(i, value)
            self.whole = True
        super().clear(side)

    def save(self) -> int:
        """Write changed orders and levels; returns how many."""
        changed = 0
        for i, was in self.were.items():
            now = self.orders.get(i)
            if now != was:
                changed += 1
                self.stored.removeKey((i,)) if now is None else self.stored.updateValue((i,), now)
        now_levels = {(side, price): qty for side, level in self.levels.items() for price, qty in level.items()}
        for at in self.levels_were.keys() | now_levels.keys():
            now = now_levels.get(at)
            if now != self.levels_were.get(at):
                changed += 1
                self.stored_levels.removeKey(at) if now is None else self.stored_levels.updateValue(at, (now,))
        return changed


class BookProcessor(StatefulProcessor):
    """One key's live book: a map of orders, a map of price levels, and a head row with what the last update left."""

    def __init__(self, keys: list[str], policy: str, on_retransmit: str, forget: bool):
        self.keys, self.policy, self.on_retransmit, self.forget = keys, policy, on_retransmit, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last long, burst boolean, day_end long, known_bid double, known_ask double")
        self.orders = handle.getMapState("orders", "id long", "side int, price double, qty double")
        self.levels = handle.getMapState("levels", "side int, price double", "qty double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get() if self.head.exists() else None
        last, burst, day_end, known_bid, known_ask = head if head is not None else (-1, False, 0, None, None)
        known = {"bid": _none(known_bid), "ask": _none(known_ask)}
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        pdf = pdf[pdf["seq"] > last]
        if not len(pdf):
            return
        book = StoredBook(self.orders, self.levels, head is None, burst, self.policy, self.on_retransmit)
        out, now = [], book.best()
        columns = [*self.keys, "seq", "t", "action", "side", "order_type", "price", *[f"{c}_before" for c in BEST], *BEST, "known_bid", "known_ask"]
        for r in pdf.itertuples(index=False):
            if r.seq <= last:
                continue
            before = now
            book.apply(int(r.action), _none(r.priority, int), _none(r.prev_priority, int), _none(r.side, int), _none(r.price, float), _none(r.qty, float))
            now = book.best()
            out.append((*key, r.seq, r.t, r.action, _none(r.side, int), _none(r.order_type, int), _none(r.price, float), *before, *now, known["bid"], known["ask"]))
            known = {"bid": now[0] if now[0] is not None else known["bid"], "ask": now[2] if now[2] is not None else known["ask"]}
            last = int(r.seq)
            if len(out) == SLICE:
                yield pd.DataFrame(out, columns=columns)
                out = []
        end = (int(pdf["t"].max()) // 1000 // DAY_MS + 1) * DAY_MS
        if self.forget and end > day_end:
            self.handle.registerTimer(end)
            day_end = end
        book.save()
        self.head.update((last, book.burst, day_end, known["bid"], known["ask"]))
        yield pd.DataFrame(out, columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The day is over for the watermark: the book goes, unless a later day has begun."""
        if self.head.exists() and self.head.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            for state in (self.head, self.orders, self.levels):
                state.clear()
        return iter([])

    def close(self) -> None:
        pass


def book_states(sdf: DataFrame, keys: list[str] = KEYS, policy: str = "display", on_retransmit: str = "reset", delay: str | None = None) -> DataFrame:
    """The rows of jobs.stream_book, and known_bid and known_ask, each side's best that was last known before the update.

    Rows are applied in the order of seq inside each micro-batch, where a key's rows are held together; those at or
    before the last applied one are dropped. With `delay` the watermark of `t` (microseconds) ends a day: rows of a day that it has left are dropped, and a
    key's book is forgotten after the last day that it had updates on.
    """
    kinds = ", ".join(f"{k} {sdf.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds}, seq long, t long, action int, side int, order_type int, price double, " + ", ".join(f"{c}{s} double" for s in ("_before", "") for c in BEST) + ", known_bid double, known_ask double"
    if delay:
        sdf = sdf.withColumn("_ts", F.timestamp_micros("t")).withWatermark("_ts", delay)
    return sdf.groupBy(*keys).transformWithStateInPandas(BookProcessor(keys, policy, on_retransmit, bool(delay)), out, "append", "EventTime" if delay else "None")


def book_outputs(states: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The events of a live book in one stream: kind `rlop` (distance of new limit orders behind the best before them) and
    `vol` (absolute log move of a side's best against the one last known), side, value. No state of their own."""
    rlop = book_events.rlop_events(states, keys).select(*keys, "seq", "t", F.lit("rlop").alias("kind"), "side", F.col("delta").alias("value"))
    move = lambda best, last: F.when((F.col(best) > 0) & (F.col(last) > 0), F.abs(F.log(F.col(best) / F.col(last))))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), move("best_bid", "known_bid").alias("value")), F.struct(F.lit(2).alias("side"), move("best_ask", "known_ask").alias("value"))))
    vol = states.select(*keys, "seq", "t", sides.alias("x")).select(*keys, "seq", "t", F.lit("vol").alias("kind"), "x.side", "x.value").filter("value is not null")
    return rlop.unionByName(vol)
