"""Live books of large deliveries: bounded micro-batches and bounded output."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import queries as Q
from tidemark.streaming import jobs, stateful

from test_queries import SF, TABLES, plain
from test_streams import Map


def test_slices_follow_one_another(spark):
    df = spark.range(5_000).selectExpr("id * 7919 % 5003 as seq", "id").union(spark.sql("select null, 1L"))
    got = [[r["seq"] for r in s.collect()] for s in Q.slices(df, "seq", 600)]
    rest = [x for s in got for x in s if x is not None]
    assert len(got) == 9 and max(map(len, got)) < 700 and sorted(rest) == sorted(r["seq"] for r in df.collect() if r["seq"] is not None)
    assert all(max(x for x in a if x is not None) < min(b) for a, b in zip(got, got[1:])) and None in got[0]
    assert len(Q.slices(df, "seq", 10_000)) == 1


@pytest.mark.parametrize("name", ["t4_stream_book", "t4_stream_outputs"])
def test_books_over_slices_equal_sql(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "DELIVERY", 400)
    whole, calls = Q.slices, []
    monkeypatch.setattr(Q, "slices", lambda *a: (calls.append(whole(*a)), calls[-1])[1])
    df = Q.QUERIES[name](spark, SF)
    assert calls and sum(map(len, calls)) >= 3
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cols = sorted(df.columns)
    want = c.sql("select " + ", ".join(cols) + f" from ({Q.ORACLE_SQL[name]}) z").fetchall()
    assert sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect()) == sorted(tuple(plain(x) for x in r) for r in want)


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def test_a_book_passes_its_output_on_in_slices():
    """A key's rows of one micro-batch come out in pieces, the same as over several micro-batches."""
    n = 2 * jobs.SLICE + 5
    rows = pd.DataFrame({"seq": range(n), "t": range(n), "action": [1, 2] * (n // 2) + [1], "priority": range(n), "prev_priority": [i - 1 for i in range(n)], "order_type": 2, "side": 1, "price": [100.0 + i % 7 for i in range(n)], "qty": 5.0})

    def run(cuts):
        book = stateful.BookProcessor(["k"], "display", "reset", False)
        book.head, book.orders, book.levels = Value(), Map(), Map()
        return [list(book.handleInputRows((1,), iter([rows[a:b]]), None)) for a, b in zip(cuts, cuts[1:])]

    (one,) = run([0, n])
    assert [len(x) for x in one] == [jobs.SLICE, jobs.SLICE, 5]
    some = [x for batch in run([0, 7, 12_000, n]) for x in batch]
    pd.testing.assert_frame_equal(pd.concat(one, ignore_index=True), pd.concat(some, ignore_index=True), check_dtype=False)
