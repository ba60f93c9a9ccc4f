"""Books by windows against a sequential replay of random update streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, book, book_events
from tidemark.streaming.jobs import LiveBook

SCHEMA = "symbol long, seq long, t long, action int, priority long, prev_priority long, order_type int, side int, price double, qty double"


def stream(seed, n=150, clears=2):
    r, rows = random.Random(seed), []
    for i in range(n):
        action = r.choices([1, 2, 3, 4, 5, 6, 9], [40, 20, clears, 15, 10, 15, 1])[0]
        if rows and rows[-1][3] == 5 and r.random() < 0.7:
            action = 5
        maybe = lambda x, p=0.08: None if r.random() < p else x
        rows.append((seed, i, i * 10 + r.randint(0, 9), action, maybe(r.randint(1, 25)), maybe(r.randint(1, 25)), r.choice([1, 2]), maybe(r.choice([1, 2]), 0.3 if action == 3 else 0.05), maybe(round(100 + r.randint(-5, 5) * 0.5, 2), 0.15), maybe(float(r.randint(1, 9)))))
    return rows


def replay(rows, policy):
    """After each update: the orders, and the best prices before and after."""
    live, out = LiveBook(policy=policy), {}
    for _, seq, t, action, priority, prev, _, side, price, qty in rows:
        before = live.best()
        live.apply(action, priority, prev, side, price, qty)
        out[seq] = (t, dict(live.orders), before, live.best())
    return out


@pytest.mark.parametrize("policy,run,clears", [("display", 65_536, 2), ("strict", 65_536, 2), ("display", 16, 13)])
def test_lifetimes_and_states_equal_replay(spark, monkeypatch, policy, run, clears):
    """With clears of 10 % of the rows, and runs of few updates, as well."""
    monkeypatch.setattr(book, "RUN", run)
    streams = {s: stream(s, clears=clears) for s in range(6)}
    df = spark.createDataFrame([r for s in streams.values() for r in s], SCHEMA)
    lives = book.order_lifetimes(df, ["symbol"], policy).collect()
    states = {(r["symbol"], r["seq"]): r for r in book_events.event_states(df, ["symbol"], policy, chunk=300).collect()}
    for s, rows in streams.items():
        truth = replay(rows, policy)
        for seq, (_, orders, before, after) in truth.items():
            alive = {x["order_id"]: (x["side"], x["price"], x["qty"]) for x in lives if x["symbol"] == s and x["start_seq"] <= seq and (x["end_seq"] is None or seq < x["end_seq"])}
            assert alive == orders, (policy, s, seq)
            got = states[(s, seq)]
            for name, want in zip(["best_bid", "bid_depth", "best_ask", "ask_depth"], before):
                assert got[f"{name}_before"] == want
            for name, want in zip(["best_bid", "bid_depth", "best_ask", "ask_depth"], after):
                assert got[name] == want


def test_snapshots_as_of(spark):
    rows = stream(3)
    df = spark.createDataFrame(rows, SCHEMA)
    truth = replay(rows, "display")
    bounds = spark.createDataFrame([(3, 0, 1400)], "symbol long, start long, end long")
    got = {r["t"]: r for r in book.snapshots(df, bounds, 50, ["symbol"]).collect()}
    assert len(got) == 29
    for t, r in got.items():
        last = [v for v in truth.values() if v[0] <= t]
        b, bq, a, aq = last[-1][3] if last else (None,) * 4
        assert (r["bid1"], r["bidvolume1"], r["ask1"], r["askvolume1"]) == (b, bq, a, aq)
        assert r["imbalance"] == (pytest.approx((bq - aq) / (bq + aq)) if b is not None and a is not None else None)


def test_event_clock_equals_loop(spark):
    rng = random.Random(5)
    rows = sorted(rng.randint(0, 1000) for _ in range(60))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "symbol long, seq long, t long")
    bounds = spark.createDataFrame([(1, 100, 900)], "symbol long, start long, end long")
    want, mark = [], 100
    for i, t in enumerate(rows):
        if 100 <= t <= 900 and mark <= 900 and t >= mark:
            want.append((mark, i))
            mark += 40
    got = sorted((r["t"], r["seq"]) for r in book.event_clock(df, bounds, 40, ["symbol"]).collect())
    assert got == want


def test_asof_both_ways_equal_loop(spark):
    from tidemark.operators import align

    rng = random.Random(2)
    left = [(1, rng.randint(0, 60), i) for i in range(80)]
    right = [(1, rng.randint(0, 60), i) for i in range(80)]
    a, b = spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, v int")
    for strict in (False, True):
        got = {r["i"]: r["v"] for r in align.asof_forward(a, b, ["k"], "t", ["v"], strict, tie="v").collect()}
        assert got == {i: min(((u, v) for _, u, v in right if u > t or (u == t and not strict)), default=(0, None))[1] for _, t, i in left}
        got = {r["i"]: r["v"] for r in align.asof_backward(a, b, ["k"], "t", ["v"], strict, tie="v").collect()}
        assert got == {i: max(((u, v) for _, u, v in right if u < t or (u == t and not strict)), default=(0, None))[1] for _, t, i in left}


def test_live_book_merges_or_resets():
    for how, want in (("reset", {7: (2, 11.0, 1.0)}), ("merge", {5: (1, 10.0, 3.0), 7: (2, 11.0, 1.0)})):
        live = LiveBook(on_retransmit=how)
        live.apply(1, 5, None, 1, 10.0, 3.0)
        live.apply(5, 7, None, 2, 11.0, 1.0)
        assert live.orders == want


def test_decrements(spark):
    rows = [(1, 1, 1, 1, 5, None, 2, 1, 10.0, 8.0), (1, 2, 2, 4, 5, None, 2, 1, 10.0, 3.0), (1, 3, 3, 1, 6, None, 2, 2, 11.0, 4.0), (1, 4, 4, 6, 7, 6, 2, 2, 12.0, 4.0), (1, 5, 5, 4, 5, None, 2, 1, None, 3.0), (1, 6, 6, 3, None, None, 2, None, None, None)]
    out = book.decrement_events(book.order_lifetimes(spark.createDataFrame(rows, SCHEMA), ["symbol"]), ["symbol"]).collect()
    assert sorted((r["seq"], r["kind"], r["decrement"]) for r in out) == [(2, "qty_down", 5.0), (4, "delete", 4.0), (5, "delete", 3.0)]


def test_cold_start_and_empty(spark):
    df = spark.createDataFrame(stream(1), SCHEMA).withColumn("start", F.lit(500)).withColumn("end", F.lit(900))
    cold = book.order_lifetimes(df, ["symbol"], session_mode="cold", start="start", end="end")
    assert cold.agg(F.min("start_t")).first()[0] >= 500
    assert book.order_lifetimes(spark.createDataFrame([], SCHEMA), ["symbol"]).count() == 0


def test_window_context_by_loops(spark):
    """Busy and empty windows, ties, repeated centres, keys of one side only, missing times, at bucket edges."""
    rng = random.Random(4)
    events = [(k, seq, rng.choice([rng.randrange(-40, 60), 100 + rng.randrange(3)])) for k in ("a", "b") for seq in range(120)] + [("c", 1, 5), ("a", 500, None)]
    centers = [(k, i, t) for k in ("a", "b", "d") for i, t in enumerate([-50, -10, 0, 9, 10, 11, 55, 100, 101, 300, 0])] + [("a", 99, None)]
    e, c = spark.createDataFrame(events, "k string, seq int, t long"), spark.createDataFrame(centers, "k string, center int, t long")
    got = sorted(tuple(r) for r in align.window_context(e, c, 10, ["k"], per=6).select("k", "center", "seq", "rank", "offset").collect())
    want = []
    for k, i, at in centers:
        if at is not None:
            near = sorted((t, seq) for x, seq, t in events if x == k and t is not None and abs(t - at) <= 10)[:6]
            want += [(k, i, seq, n + 1, t - at) for n, (t, seq) in enumerate(near)]
    assert got == sorted(want) and len(got) > 50
    assert align.window_context(e.limit(0), c, 10, ["k"]).count() == 0 and align.window_context(e, c.limit(0), 10, ["k"]).count() == 0
