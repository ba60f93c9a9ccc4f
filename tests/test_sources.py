import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import sessions, trades
from tidemark.sources import readers, sinks

NS = 1569906121234567891


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_order_updates(spark, tmp_path):
    path = write(tmp_path, "u.csv", [f"7,OrderUpdate,0,1,{NS},[2,{{100,1,55,,2,10.5,1,20,}},{{100,2,,55}}]", f"8,OrderUpdate,0,1,{NS + 1},[1,{{100,1.0,56,-,2,-,2,30,,9,9}}]", f"9,OrderUpdate,0,1,{NS},[1,{{,1,5,,2,1,1,1,}}]", f"10,Other,0,1,{NS},[1,{{1,1,1,1,1,1,1,1,1}}]", "junk"])
    rows = readers.read_order_updates(spark, path).orderBy("md_seq", "group_pos").collect()
    assert [(r["md_seq"], r["group_pos"], r["action"], r["priority"], r["prev_priority"], r["price"], r["qty"]) for r in rows] == [(7, 0, 1, 55, None, 10.5, 20.0), (7, 1, 2, None, 55, None, None), (8, 0, 1, 56, None, None, 30.0)]
    assert rows[0]["event_time_ns"] == NS and str(rows[0]["trade_date"]) == "2019-10-01"
    strict = readers.read_order_updates(spark, path, lenient=False).collect()
    assert {r["md_seq"] for r in strict} == {7}  # "1.0" is no action there
    assert readers.read_order_updates(spark, path, max_groups=1).count() == 1


def test_market_status_and_intervals(spark, tmp_path):
    line = lambda q, t, state, session, reason="": f"{q},MarketStatusChange,0,1,[1,{{,100,{t},{state},{reason},,2,4,,,1,{session},,}}]"
    path = write(tmp_path, "s.csv", [line(1, 10, 3, ""), line(2, 20, 5, 0), line(3, 30, 5, 2), line(4, 90, 2, 1), line(5, 90, 2, 1, 4)])
    df = readers.read_market_status(spark, path)
    assert [(r["md_change_type"], r["phase_qualifier"], r["session"]) for r in df.orderBy("md_seq").collect()] == [(0, 0, 1), (0, 0, 1), (0, 0, 2), (0, 0, 1), (0, 0, 1)]
    iv = sessions.status_intervals(df, ["symbol_index"]).orderBy("start_ns", "md_seq").collect()
    assert [(r["start_ns"], r["end_ns"], r["book_state"]) for r in iv] == [(10, 20, 3), (20, 90, 5), (90, 90, 2), (90, None, 2)]
    labelled = C.label_codes(sessions.status_intervals(df, ["symbol_index"]), "book_state", C.BOOK_STATES)
    s = sessions.main_session(labelled, keys=["symbol_index"]).first()
    assert (s["start"], s["end"]) == (20, 90)
    inside = sessions.filter_continuous(spark.createDataFrame([(100, t) for t in (19, 20, 90, 91)], "symbol_index long, event_time_ns long"), sessions.main_session(labelled, keys=["symbol_index"]), keys=["symbol_index"])
    assert sorted(r["event_time_ns"] for r in inside.collect()) == [20, 90]


def trade_line(flags="[1,{0,0,0,1,0,0,0,0}]", qty="5", kind="FullTradeInformation", n=50):
    f = [""] * 50
    f[0], f[1], f[2], f[3], f[4], f[5] = "9", kind, "0", "1", str(NS), "100"
    f[12], f[13], f[21], f[22], f[45] = "80.5", qty, "1", "2", "XPAR"
    f[35] = flags
    return ",".join(f[:n])


def test_full_trades(spark, tmp_path):
    path = write(tmp_path, "t.csv", [trade_line(), trade_line("[1,{0,0,1,0,,,,}]"), trade_line("[1,{0,0,1,1,0,0,0,0}]"), trade_line("", ""), trade_line(n=40), trade_line(kind="Other")])
    df = readers.read_full_trades(spark, path)
    out = trades.with_trade_sign(df, "TradeQualifierSeq", "MiFIDQuantity").collect()
    assert sorted((r["sign"], r["signed_qty"]) for r in out) == [(-1, -5.0), (0, 0.0), (1, 5.0), (1, 5.0)]
    assert {r["Venue"] for r in out} == {"XPAR"} and out[0]["EventTimeNs"] == NS and out[0]["flags"]["aggressive_buy"] == 1
    assert readers.read_trades_minimal(spark, path).count() == 4


def test_times_and_cutoff(spark):
    df = spark.createDataFrame([(1569943800000000000,), (1569943800001000000,), (0,), (None,)], "event_time_ns long")
    rows = C.with_times(df).collect()
    assert rows[0]["time_utc"] == "2019-10-01 15:30:00.000000" and rows[0]["time_local"] == "2019-10-01 17:30:00.000000" and rows[2]["time_utc"] == "" and rows[3]["time_local"] == ""
    assert C.filter_cutoff(C.with_times(df), "17:30:00").count() == 1


def test_tables(spark, tmp_path):
    p = write(tmp_path, "e.csv", ["t,v", "2019-10-01 09:00:00+02:00,1", "bad,2"])
    assert [str(r["ts"]) for r in readers.read_events_csv(spark, p, "t").collect()] == ["2019-10-01 07:00:00"]
    p = write(tmp_path, "p.csv", ["Date,Close", "2020-01-01,10", "2020-01-02,x", "2020-01-03,12", "2020-02-01,9"])
    assert [r["value"] for r in readers.read_price_series(spark, p, end="2020-01-31").orderBy("day").collect()] == [10.0, 12.0]
    p = write(tmp_path, "d.csv", ["timestamp,p1,q1,p2,q2,x", "2020-01-01 00:00:00,1,2,3,4,5"])
    assert readers.read_depth_wide(spark, p).columns == ["ts", "p1", "q1", "p2", "q2"]
    p = write(tmp_path, "c.tsv", ["A\t3", "x\t2020-01-01 00:00:00", "y\t2020-01-01 00:01:40", "B\t1", "z\t2020-01-02 00:00:00"])
    assert sorted(r["t"] for r in readers.read_cluster_times(spark, p, "A").collect()) == [0.0, 0.001]
    snap = spark.sql("select timestamp_ntz'2019-10-01 11:00:00' as timestamp, 100.0D as bidvolume1, 0.0D as askvolume1")
    snap.write.parquet(str(tmp_path / "snap"))
    got = readers.read_snapshots(spark, str(tmp_path / "snap"), "bid").first()
    assert str(got["ts"]) == "2019-10-01 09:00:00" and got["log_volume"] == pytest.approx(4.60517, abs=1e-5)
    assert readers.read_snapshots(spark, str(tmp_path / "snap"), "ask").count() == 0
    with pytest.raises(ValueError):
        readers.read_snapshots(spark, str(tmp_path / "snap"), "mid")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "freq int, side string, x double")
    sinks.write_table(df, str(tmp_path / "out"), ("freq", "side"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("freq = 2").first()["x"] == 3.0
    sinks.write_table(df, str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).count() == 2
    assert json.loads(sinks.summary_json(df.filter("freq = 1")).first()["json"]) == {"freq": 1, "side": "a", "x": 2.0}


def test_tick_sizes(spark):
    df = spark.createDataFrame([(0.05,), (10.0,), (19.99,), (60000.0,), (None,), (-1.0,)], "price double")
    assert [r["tick"] for r in trades.with_tick_size(df, 6).collect()] == [0.0001, 0.002, 0.002, 10.0, None, None]
    with pytest.raises(ValueError):
        trades.with_tick_size(df, 7)
    half = spark.createDataFrame([(1, 1, "2", 100.0), (1, 2, "2", 100.25), (1, 3, "1", 50.0), (1, 4, "2", 100.75)], "k int, seq int, mode string, price double").withColumn("t_us", F.col("seq"))
    assert [r["jump"] for r in trades.tick_jumps(half, 3, ["k"]).orderBy("seq").collect()] == [1, 2]  # 1.25 and 2.5 ticks, half to even
