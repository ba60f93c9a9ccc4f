"""Late rows, deliveries in any order, and state that is written by change."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.plans.queries import STORE
from tidemark.streaming import jobs, stateful


def deliver(spark, parts, job, schema, maps=True):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"
    if maps:
        spark.conf.set(STORE, stateful.ROCKSDB)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = job(spark.readStream.schema(schema).parquet(f"{base}/in"))
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset(STORE)
    return spark.read.schema(out.schema).parquet(f"{base}/out").collect()


STATUS = "symbol int, event_time_ns long, md_seq long, state string"


def test_late_status_rows_are_dropped(spark):
    """The second delivery brings a row from before the last applied one: it changes nothing that was emitted."""
    first, second = [(1, 100, 1, "A"), (1, 300, 3, "B")], [(1, 200, 2, "C"), (1, 300, 3, "B"), (1, 400, 4, "A"), (2, 50, 5, None)]
    got = deliver(spark, [first, second], lambda s: jobs.stream_intervals(s, ["state"], ["symbol"]), STATUS, maps=False)
    assert sorted(tuple(r) for r in got) == [(1, 100, 300, "A"), (1, 300, 400, "B")]


def test_ordered_intervals_do_not_depend_on_deliveries(spark):
    r, second = random.Random(5), 1_000_000_000
    rows = [(s, (i * 7 + r.randint(0, 6)) * second, 10 * i + s, r.choice(["A", "B", None])) for i in range(60) for s in (1, 2)]
    rows += [(1, rows[30][1], 9_999, "tie")]
    until = max(t for _, t, *_ in rows) - 60 * second
    want = []
    for s in (1, 2):
        open_ = None
        for _, t, _, state in sorted(x for x in rows if x[0] == s and x[1] // 10**6 <= until // 10**6):
            if open_ is not None and open_[1] == state:
                continue
            if open_ is not None:
                want.append((s, open_[0], t, open_[1]))
            open_ = (t, state)
    arrival = sorted(rows, key=lambda x: (x[1] + r.randint(0, 50) * second, x[2]))
    for cuts in ([0, len(rows)], [0, 40, 41, 90, len(rows)]):
        got = deliver(spark, [arrival[a:b] for a, b in zip(cuts, cuts[1:])], lambda s: stateful.ordered_intervals(s, ["state"], "60 seconds", ["symbol"]), STATUS)
        assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)


class Map:
    """A map state that counts what is read and written."""

    def __init__(self):
        self.rows, self.reads, self.writes = {}, 0, 0

    def getValue(self, k):
        self.reads += 1
        return self.rows.get(k)

    def updateValue(self, k, v):
        self.writes += 1
        self.rows[k] = v

    def removeKey(self, k):
        self.writes += 1
        self.rows.pop(k, None)

    def iterator(self):
        return iter(list(self.rows.items()))


@pytest.mark.parametrize("mode", ["reset", "merge"])
def test_stored_book_writes_what_changes(mode):
    """Batches over the maps equal one book in memory, and a batch writes in proportion to its updates, not to the book."""
    r = random.Random(3)
    orders, levels, burst, book, n = Map(), Map(), False, jobs.LiveBook(on_retransmit=mode), 0
    for batch in range(40):
        stored = stateful.StoredBook(orders, levels, batch == 0, burst, "display", mode)
        before = (orders.writes + levels.writes, orders.reads)
        size = 2_000 if batch == 0 else r.randint(1, 12)
        for _ in range(size):
            action = r.choices([1, 2, 4, 5, 6, 3], [60, 15, 15, 1, 9, 0.3])[0] if batch else 1
            n += 1
            prev = r.randint(max(1, n - 50), n)
            update = (action, None if action == 2 else prev if action == 4 else n, prev if action in (2, 6) else None, r.choice([1, 2]), r.choice([None, 0.0, 99.0, 100.0, 101.5]), r.choice([1.0, 7.0]))
            stored.apply(*update)
            book.apply(*update)
            assert stored.best() == book.best()
            cleared = action in (3, 5)
            size += 10**6 if cleared else 0
        stored.save()
        burst = stored.burst
        assert orders.writes + levels.writes - before[0] <= 6 * size + 10 and orders.reads - before[1] <= 4 * size
        assert {k[0]: v for k, v in orders.rows.items()} == book.orders
        assert {(s, p): q for s, level in book.levels.items() for p, q in level.items()} == pytest.approx({k: v[0] for k, v in levels.rows.items()})


UPDATES = "symbol int, seq long, t long, action int, priority long, prev_priority long, order_type int, side int, price double, qty double"


def test_live_book_outputs_and_days(spark):
    """Both kinds of events over deliveries with late rows; with a delay the book ends with its day."""
    day = 86_400_000_000
    new = lambda s, seq, t, side, price: (s, seq, t, 1, seq, None, 2, side, price, 5.0)
    first = [new(1, 1, 10, 1, 99.0), new(1, 2, 20, 2, 101.0), new(1, 3, 30, 1, 98.0), new(1, 4, 40, 1, 100.0)]
    late = [new(1, 2, 25, 2, 1.0), new(1, 5, day + 10, 1, 97.0), new(1, 6, day + 20, 2, 103.0)]
    job = lambda delay: lambda s: stateful.book_outputs(stateful.book_states(s, ["symbol"], delay=delay), ["symbol"])
    got = {(r["seq"], r["kind"], r["side"]): r["value"] for r in deliver(spark, [first, late], job(None), UPDATES)}
    assert {k: v for k, v in got.items() if k[1] == "rlop"} == {(3, "rlop", 1): 1.0, (5, "rlop", 1): 3.0, (6, "rlop", 2): 2.0}
    assert got[4, "vol", 1] == pytest.approx(0.010050336) and got[5, "vol", 1] == 0 and (2, "vol", 1) in got and (1, "vol", 1) not in got
    # a delivery of the next day on another symbol moves the watermark past the first day's end
    end = [new(2, 7, day + 3_700_000_000, 1, 50.0)]
    again = [new(1, 8, day + 3_800_000_000, 1, 97.0)]
    states = deliver(spark, [first, end, again], lambda s: stateful.book_states(s, ["symbol"], delay="1 hour"), UPDATES)
    assert [(r["best_bid_before"], r["best_ask_before"], r["known_bid"], r["best_bid"]) for r in states if r["seq"] == 8] == [(None, None, None, 97.0)]
    kept = deliver(spark, [first, again], lambda s: stateful.book_states(s, ["symbol"]), UPDATES)
    assert [(r["best_bid_before"], r["best_ask_before"]) for r in kept if r["seq"] == 8] == [(100.0, 101.0)]
