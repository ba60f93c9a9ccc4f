"""One query per operator over the canonical inputs, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import columns as C
from ..functions.scratch import scratch, written
from ..operators import align, bars, book, book_events, distribution, entropy, hawkes, kde, series, sessions, stationarity, trades
from .views import KEY, Views, duck

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    def put(f):
        def run(spark, sf_dir):
            return f(Views(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = f"{duck(*views.split())}\n{sql.strip()}" if sql.lstrip().startswith(("select", ",")) else sql
        return f

    return put


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def bounds_of(v: Views) -> DataFrame:
    """A session for each key: three hours from an hour after its first update."""
    return v.updates.groupBy(*KEY).agg((F.min("t") + HOUR).alias("start"), (F.min("t") + 4 * HOUR).alias("end"))


BOUNDS = "bounds as (select symbol, min(t) + 3600000000 as start, min(t) + 14400000000 as stop from v_updates group by symbol)"

# --- projections and filters


@query("p1_label_codes", "updates", "select symbol, seq, case action when 1 then 'New' when 2 then 'Delete (by Previous Priority)' when 3 then 'Delete All (by side or whole book)' when 4 then 'Modify (no loss of priority)' when 5 then 'Retransmission (full book refresh)' else 'Modify (loss of priority)' end as action_label, case side when 1 then 'Buy' when 2 then 'Sell' else '' end as side_label, case when order_type = 1 then 'Market' else 'Limit' end as order_type_label from v_updates")
def _(v):
    df = C.label_codes(C.label_codes(C.label_codes(v.updates, "action", C.ACTIONS), "side", C.SIDES), "order_type", C.ORDER_TYPES, "Type(%d)")
    return df.select("symbol", "seq", "action_label", "side_label", "order_type_label")


@query("p2_times", "status", "select symbol, md_seq, strftime(make_timestamp(event_time_ns // 1000), '%Y-%m-%d %H:%M:%S.%f') as time_utc from v_status")
def _(v):
    return C.with_times(v.status).select("symbol", "md_seq", "time_utc")


SESSION = """, m as (select symbol, md_seq, event_time_ns as start, lead(event_time_ns) over (partition by symbol order by event_time_ns, md_seq) as stop, book_state from v_status),
i as (select symbol, start, stop, book_state, sum(new) over (partition by symbol order by start, md_seq) as run from
  (select *, case when book_state = lag(book_state) over (partition by symbol order by start, md_seq) then 0 else 1 end as new from m) z),
j as (select symbol, run, min(start) as start, max_by(stop, start) as stop, min(book_state) as book_state, bool_or(stop is null) as open from i group by symbol, run),
k as (select symbol, start, case when not open then stop end as stop, book_state from j),
s as (select symbol, start, stop from (select *, row_number() over (partition by symbol order by (stop - start) desc, start) as r from k where book_state = 1 and stop is not null) q where r = 1)
"""


def sessions_of(v):
    iv = sessions.status_intervals(v.status, KEY, state=["book_state"])
    return sessions.main_session(iv.withColumn("label", F.when(F.col("book_state") == 1, "Continuous").otherwise("Call")), "label", keys=KEY)


@query("p3_filter_continuous", "status trades", SESSION + "select t.symbol, t.seq, t.price from v_trades t join s on t.symbol = s.symbol where t.t_us * 1000 between s.start and s.stop")
def _(v):
    return sessions.filter_continuous(v.trades.withColumn("event_time_ns", F.col("t_us") * 1000), sessions_of(v), keys=KEY).select("symbol", "seq", "price")


@query("p4_filter_cutoff", "trades", "select symbol, seq from v_trades where t_us % 86400000000 <= 63000000000")
def _(v):
    return C.filter_cutoff(v.trades.withColumn("ts", F.timestamp_micros("t_us")), "17:30:00", tz="UTC").select("symbol", "seq")


@query("p5_trade_sign", "trades", "select symbol, seq, cast(case when seq % 3 = 0 then 1 when seq % 3 = 1 then -1 else 0 end as int) as sign, cast(case when seq % 3 = 0 then qty when seq % 3 = 1 then -qty else 0 end as double) as signed_qty from v_trades")
def _(v):
    flags = F.when(F.col("seq") % 3 == 0, "[1,{0,1,0,1,0,0,0,0}]").when(F.col("seq") % 3 == 1, "[1,{0,0,1,,0,0,0,0}]").otherwise("[1,{1,0,0,0,0,0,0,0}]")
    return trades.with_trade_sign(v.trades.drop("sign", "signed_qty").withColumn("qualifier", flags)).select("symbol", "seq", "sign", "signed_qty")


@query("p6_clean_trades", "trades", "select symbol, seq, price, qty, sign from v_trades where mechanism = 1 and mode = '2' and sign in (1, -1)")
def _(v):
    return trades.clean_trades(v.trades).select("symbol", "seq", "price", "qty", "sign")


@query("p7_log_volume", "series", "select symbol, day, round(ln(q - 50), 6) as log_volume from v_series where q - 50 > 0")
def _(v):
    return r6(distribution.log_volume(v.series.withColumn("volume", F.col("q") - 50)).select("symbol", "day", "log_volume"), "log_volume")


@query("p8_return_events", "series", "select symbol, day, t_index, round(r, 6) as log_return from (select *, cast(row_number() over (partition by symbol order by day) - 1 as int) as t_index from (select symbol, day, ln(x / lag(x) over (partition by symbol order by day)) as r from v_series) a where r is not null) b where abs(r) > 0.3")
def _(v):
    return r6(series.return_events(v.series, 0.3, "abs_gt", "x", KEY, "day").select("symbol", "day", "t_index", "log_return"), "log_return")


@query("p9_time_of_day", "trades", "select t.symbol, t.seq from v_trades t join (select symbol, min(t_us // 86400000000) as d from v_trades group by symbol) f on t.symbol = f.symbol and t.t_us // 86400000000 = f.d where (t.t_us % 86400000000) // 60000000 between 540 and 660")
def _(v):
    return C.time_of_day_mask(v.trades.withColumn("ts", F.timestamp_micros("t_us")), "09:00", "11:00", keys=KEY).select("symbol", "seq")


@query("p10_split_halves", "series", "select symbol, case when day <= m then 1 else 2 end as half, cast(case when day <= m then day else day - m end as double) as t from (select symbol, cast(day as double) as day, max(day) over (partition by symbol) / 2 as m from v_series) a")
def _(v):
    return series.split_halves(v.series.select("symbol", F.col("day").cast("double").alias("t")), KEY).select("symbol", "half", "t")


@query("p11_valid_side", "updates", "select symbol, seq from v_updates where side is null or side in (1, 2)")
def _(v):
    return C.valid_side(v.updates).select("symbol", "seq")


@query("p13_complete_cases", "updates", "select symbol, seq, price, qty from v_updates where price is not null and qty is not null")
def _(v):
    return C.complete_cases(v.updates, ["symbol", "seq", "price", "qty", "not_there"])


# --- book

LIVES = """
, ok as (select *, coalesce(price > 0, false) and side is not null and qty is not null as good from v_updates),
clr as (select symbol, seq, t, side from v_updates where action = 3 union all
  select symbol, seq, t, null from (select *, lag(action) over (partition by symbol order by seq) as b from v_updates) z where action = 5 and b is distinct from 5),
touch as (
  select symbol, seq, t, action, prev_priority as id, 0 as sub, false as put, null::int as side, null::double as price, null::double as qty from ok where action in (2, 6) and prev_priority is not null
  union all select symbol, seq, t, action, priority, 0, false, null, null, null from ok where action = 4 and priority is not null and not good and side is not null and qty is not null
  union all select symbol, seq, t, action, priority, 1, true, side, price, qty from ok where action in (1, 4, 5, 6) and priority is not null and good),
nxt as (select *, lead(seq) over w as nseq, lead(t) over w as nt, lead(action) over w as nact, lead(qty) over w as nqty from touch window w as (partition by symbol, id order by seq, sub)),
cut as (select n.*, (select min(c.seq) from clr c where c.symbol = n.symbol and c.seq > n.seq and (c.side is null or c.side = n.side)) as cseq from nxt n where put),
lives as (select u.symbol, id as order_id, u.side, u.price, u.qty, u.seq as start_seq, u.t as start_t,
    case when cseq is not null and (nseq is null or cseq < nseq or (cseq = nseq and nact in (3, 5))) then cseq else nseq end as end_seq,
    case when cseq is not null and (nseq is null or cseq < nseq or (cseq = nseq and nact in (3, 5))) then (select any_value(c.t) from clr c where c.symbol = u.symbol and c.seq = cseq) else nt end as end_t,
    case when cseq is not null and (nseq is null or cseq < nseq or (cseq = nseq and nact in (3, 5))) then null else nact end as end_action,
    case when cseq is not null and (nseq is null or cseq < nseq or (cseq = nseq and nact in (3, 5))) then null else nqty end as next_qty
  from cut u where coalesce(nseq, u.seq + 1) > u.seq)
"""
GRID = f", {BOUNDS}, grid as (select symbol, unnest(range(start, stop + 1, 600000000)) as t from bounds)"
LEVELS = LIVES + GRID + """
, lev as (select g.symbol, g.t, l.side, l.price, sum(l.qty) as qty from grid g join lives l on g.symbol = l.symbol and l.start_t <= g.t and (l.end_t is null or g.t < l.end_t)
  group by all having sum(l.qty) > 0)
"""


def lives_of(v, **how):
    return book.order_lifetimes(v.updates, KEY, **how)


def levels_of(v, step=600_000_000):
    return book.levels_at(book.level_intervals(lives_of(v), KEY), book.time_grid(bounds_of(v), step, KEY), KEY)


@query("l1_order_lifetimes", "updates", LIVES + "select symbol, order_id, side, price, qty, start_seq, end_seq, end_action, next_qty from lives")
def _(v):
    return lives_of(v).select("symbol", "order_id", "side", "price", "qty", "start_seq", "end_seq", "end_action", "next_qty")


@query("l2_policies", "updates", LIVES.replace("and not good and side is not null and qty is not null", "and not good") + "select symbol, side, count(*) as n, sum(qty) as qty, count(end_seq) as ended from lives group by symbol, side")
def _(v):
    return lives_of(v, policy="strict").groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.count("end_seq").alias("ended"))


@query("l3_market_buckets", "updates", """
, full_clear as (select symbol, seq from v_updates where action = 3 and side is null union all select symbol, seq from (select *, lag(action) over (partition by symbol order by seq) as b from v_updates) z where action = 5 and b is distinct from 5),
e as (select u.*, count(c.seq) over (partition by u.symbol order by u.seq) as epoch from v_updates u left join full_clear c on u.symbol = c.symbol and u.seq = c.seq)
select symbol, seq, sum(case when side = 1 then qty else 0 end) over w as market_buy, sum(case when side = 2 then qty else 0 end) over w as market_sell
from e where action in (1, 4, 5, 6) and priority is not null and side is not null and qty is not null and not coalesce(price > 0, false) and order_type = 1
window w as (partition by symbol, epoch order by seq rows unbounded preceding)""")
def _(v):
    return book.market_buckets(v.updates, KEY)


@query("l4_book_at", "updates", LEVELS + "select symbol, t, side, count(*) as levels, sum(qty) as qty from lev group by all")
def _(v):
    return levels_of(v).groupBy("symbol", "t", "side").agg(F.count(F.lit(1)).alias("levels"), F.sum("qty").alias("qty"))


@query("l5_levels", "updates", LEVELS + "select symbol, t, side, price, qty from lev")
def _(v):
    return levels_of(v).select("symbol", "t", "side", "price", "qty")


@query("l6_depth_cumulative", "updates", LEVELS + "select * from (select symbol, t, side, price, cast(row_number() over w as int) as level, sum(qty) over w as cum_qty from lev window w as (partition by symbol, t, side order by case when side = 1 then -price else price end)) z where level <= 10")
def _(v):
    return book.depth_cumulative(levels_of(v), ["symbol", "t"], 10).select("symbol", "t", "side", "price", "level", "cum_qty")


TOP = LEVELS + ", rk as (select *, row_number() over (partition by symbol, t, side order by case when side = 1 then -price else price end) as level from lev)"
WIDE = ", ".join(f"max(case when side = {s} and level = {i} then {c} end) as {n}{i}" for i in range(1, 6) for s, c, n in ((1, "price", "bid"), (1, "qty", "bidvolume"), (2, "price", "ask"), (2, "qty", "askvolume")))


@query("l7_top_n_levels", "updates", TOP + f"select symbol, t, {WIDE} from rk where level <= 5 group by all")
def _(v):
    return book.top_n_levels(levels_of(v), ["symbol", "t"], 5)


BBO = TOP + ", bb as (select symbol, t, max(case when side = 1 then price end) as best_bid, min(case when side = 2 then price end) as best_ask, max(case when side = 1 and level = 1 then qty end) as vb, max(case when side = 2 and level = 1 then qty end) as va from rk group by all)"


@query("l8_bbo", "updates", BBO + "select symbol, t, best_bid, best_ask, round(best_ask - best_bid, 6) as spread, round((best_ask + best_bid) / 2, 6) as mid_price from bb")
def _(v):
    return r6(book.bbo(levels_of(v), ["symbol", "t"]).select("symbol", "t", "best_bid", "best_ask", "spread", "mid_price"), "spread", "mid_price")


@query("l9_imbalance", "updates", BBO + "select symbol, t, round(case when vb + va = 0 then 0 else (vb - va) / (vb + va) end, 6) as imbalance from bb")
def _(v):
    return r6(book.imbalance(levels_of(v), ["symbol", "t"]), "imbalance")


@query("l10_depth_at_best", "updates", BBO + "select symbol, t, case when vb is not null and va is not null then vb end as bid_depth, case when vb is not null and va is not null then va end as ask_depth from bb")
def _(v):
    return book.bbo(levels_of(v), ["symbol", "t"]).select("symbol", "t", "bid_depth", "ask_depth")


@query("l11_snapshots", "updates", BBO + f", w5 as (select symbol, t, {WIDE} from rk where level <= 5 group by all) select g.symbol, g.t, w5.* exclude (symbol, t), round(best_ask - best_bid, 6) as spread, round((best_ask + best_bid) / 2, 6) as mid_price, round((vb - va) / (vb + va), 6) as imbalance from grid g left join w5 on g.symbol = w5.symbol and g.t = w5.t left join bb on g.symbol = bb.symbol and g.t = bb.t")
def _(v):
    return r6(book.snapshots(v.updates, bounds_of(v), 600_000_000, KEY), "spread", "mid_price", "imbalance")


@query("l12_event_clock", "updates", f""", {BOUNDS}, grid as (select symbol, unnest(range(start, stop + 1, 60000000)) as t from bounds),
ins as (select u.symbol, u.t, u.seq, row_number() over (partition by u.symbol order by u.t, u.seq) - 1 as i from v_updates u join bounds b on u.symbol = b.symbol and u.t between b.start and b.stop),
f as (select g.symbol, g.t, row_number() over (partition by g.symbol order by g.t) - 1 as k, (select count(*) from ins where ins.symbol = g.symbol and ins.t < g.t) as f from grid g),
n as (select symbol, t, k + max(f - k) over (partition by symbol order by t rows unbounded preceding) as i from f)
select n.symbol, n.t, ins.seq from n join ins on n.symbol = ins.symbol and n.i = ins.i""")
def _(v):
    return book.event_clock(v.updates, bounds_of(v), 60_000_000, KEY)


EVENTS = LIVES + """
, chg as (select symbol, side, price, start_seq as seq, qty as d from lives union all select symbol, side, price, end_seq, -qty from lives where end_seq is not null),
net as (select symbol, side, price, seq, sum(d) as d from chg group by all),
lv as (select symbol, side, price, seq, sum(d) over (partition by symbol, side, price order by seq) as qty, lead(seq) over (partition by symbol, side, price order by seq) as to_seq from net),
st as (select u.symbol, u.seq, u.t, u.action, u.side, u.order_type, u.price,
    max(case when l.side = 1 then l.price end) as bb, min(case when l.side = 2 then l.price end) as ba
  from v_updates u left join lv l on u.symbol = l.symbol and l.seq <= u.seq and (l.to_seq is null or u.seq < l.to_seq) and l.qty > 0 group by all),
st2 as (select *, lag(bb) over (partition by symbol order by seq) as bb0, lag(ba) over (partition by symbol order by seq) as ba0 from st)
"""


@query("l13_event_states", "updates", EVENTS + "select symbol, seq, bb as best_bid, ba as best_ask, bb0 as best_bid_before, ba0 as best_ask_before from st2")
def _(v):
    return book_events.event_states(v.updates, KEY).select("symbol", "seq", "best_bid", "best_ask", "best_bid_before", "best_ask_before")


@query("l14_crossed_book", "updates", BBO + "select symbol, t, best_bid, best_ask from bb where best_bid > best_ask")
def _(v):
    return book.crossed_book(levels_of(v), ["symbol", "t"])


@query("l15_imbalance_series", "updates", BBO + "select symbol, t, round((vb - va) / (vb + va), 6) as imbalance from bb where vb is not null and va is not null")
def _(v):
    return r6(book.imbalance_series(v.updates, bounds_of(v), 600_000_000, KEY), "imbalance")


DECREMENTS = LIVES + """, dec as (select symbol, end_seq as seq, end_t as t, side, price, case when end_action in (2, 6) or next_qty is null then 'delete' else 'qty_down' end as kind,
  case when end_action = 4 and next_qty is not null then qty - next_qty else qty end as decrement from lives where end_action in (2, 6) or (end_action = 4 and (next_qty is null or next_qty < qty)))"""


@query("l16_decrement_events", "updates", DECREMENTS + "select symbol, seq, side, price, kind, decrement from dec")
def _(v):
    return book.decrement_events(lives_of(v), KEY).select("symbol", "seq", "side", "price", "kind", "decrement")


@query("l17_rlop_events", "updates", EVENTS + "select symbol, seq, side, round(d, 6) as delta from (select *, case when side = 1 then bb0 - price else price - ba0 end as d from st2 where action = 1 and order_type = 2 and price is not null and bb0 is not null and ba0 is not null) z where d > 0")
def _(v):
    return r6(book_events.rlop_events(book_events.event_states(v.updates, KEY), KEY).select("symbol", "seq", "side", "delta"), "delta")


@query("l18_vol_events", "updates", EVENTS + ", b as (select symbol, seq, 1 as side, bb as best from st2 where bb is not null union all select symbol, seq, 2, ba from st2 where ba is not null) select symbol, seq, side, round(abs(ln(best / last)), 6) as vol from (select *, lag(best) over (partition by symbol, side order by seq) as last from b) z where last is not null")
def _(v):
    return r6(book_events.vol_events(book_events.event_states(v.updates, KEY), KEY).select("symbol", "seq", "side", "vol"), "vol")


@query("l19_micro_events", "updates", EVENTS + "select symbol, seq, round(ba0 - bb0, 6) as spread, round((ba0 + bb0) / 2, 6) as mid from st2")
def _(v):
    states = book_events.event_states(v.updates, KEY)
    return r6(book_events.micro_events(states, lives_of(v), KEY).select("symbol", "seq", "spread", "mid"), "spread", "mid")


@query("l20_cold_start", "updates", f", {BOUNDS}, v_cold as (select u.* from v_updates u join bounds b on u.symbol = b.symbol and u.t between b.start and b.stop)" + LIVES.replace("v_updates", "v_cold") + "select symbol, side, count(*) as n, sum(qty) as qty, count(end_seq) as ended from lives group by symbol, side")
def _(v):
    cold = v.updates.join(bounds_of(v), KEY)
    return book.order_lifetimes(cold, KEY, session_mode="cold", start="start", end="end").groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.count("end_seq").alias("ended"))


@query("l21_log_volume_samples", "updates", (TOP + "select symbol, t, side, cast(level as int) as level, round(ln(qty), 6) as log_volume from rk where level <= 3").replace("min(t) + 3600000000 as start, min(t) + 14400000000 as stop", "min(t) as start, max(t) as stop").replace("600000000)", "21600000000)"))
def _(v):
    return r6(book.log_volume_samples(v.updates, 6 * HOUR, 3, KEY), "log_volume")


@query("p12_classify_updates", "updates", LIVES + """
select u.symbol, u.seq, (u.action = 1 and u.order_type = 2 and u.side = 1)::int as limit_new_bid, (u.action = 1 and u.order_type = 2 and u.side = 2)::int as limit_new_ask,
  coalesce(((u.action in (2, 6) or (u.action = 4 and l.qty > u.qty)) and l.side = 1)::int, 0) as cancel_bid, coalesce(((u.action in (2, 6) or (u.action = 4 and l.qty > u.qty)) and l.side = 2)::int, 0) as cancel_ask
from v_updates u left join lives l on u.symbol = l.symbol and u.seq = l.end_seq and l.end_action is not null and l.order_id = case when u.action = 4 then u.priority else u.prev_priority end""".replace("(u.action = 1 and u.order_type = 2 and u.side = 1)::int", "coalesce((u.action = 1 and u.order_type = 2 and u.side = 1)::int, 0)").replace("(u.action = 1 and u.order_type = 2 and u.side = 2)::int", "coalesce((u.action = 1 and u.order_type = 2 and u.side = 2)::int, 0)"))
def _(v):
    return book.classify_updates(v.updates, lives_of(v), KEY).select("symbol", "seq", "limit_new_bid", "limit_new_ask", "cancel_bid", "cancel_ask")


# --- joins


@query("j1_interval_join", "updates", LIVES + GRID + "select g.symbol, g.t, count(*) as live, sum(l.qty) as qty from grid g join lives l on g.symbol = l.symbol and l.start_t <= g.t and (l.end_t is null or g.t < l.end_t) group by all")
def _(v):
    lives = lives_of(v).select("symbol", "side", F.lit(1.0).alias("price"), "qty", F.col("start_seq").alias("from_seq"), F.col("start_t").alias("from_t"), F.col("end_seq").alias("to_seq"), F.col("end_t").alias("to_t")).filter("to_t is null or to_t > from_t")
    return book.levels_at(lives, book.time_grid(bounds_of(v), 600_000_000, KEY), KEY).groupBy("symbol", "t").agg(F.count(F.lit(1)).alias("live"), F.sum("qty").alias("qty"))


@query("j2_window_sums", "updates trades", DECREMENTS + "select t.symbol, t.seq, coalesce(sum(d.decrement), 0) as window_sum from v_trades t left join dec d on t.symbol = d.symbol and d.t between t.t_us - 300000000 and t.t_us + 300000000 group by t.symbol, t.seq")
def _(v):
    centers = v.trades.select("symbol", "seq", F.col("t_us").alias("t"))
    return align.window_sums(book.decrement_events(lives_of(v), KEY), centers, 300_000_000, KEY).select("symbol", "seq", "window_sum")


HOURS = "h as (select symbol, unnest(range(min(t_us) // 3600000000 * 3600000000, max(t_us) + 1, 3600000000)) as t from v_trades group by symbol)"


def hours_of(v):
    return v.trades.groupBy("symbol").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b")).select("symbol", F.explode(F.sequence(F.expr(f"a div {HOUR} * {HOUR}"), "b", F.lit(HOUR))).alias("t"))


@query("j3_asof_forward", "trades", f", {HOURS} select h.symbol, h.t, (select min(struct_pack(a := t.t_us, b := t.seq)) from v_trades t where t.symbol = h.symbol and t.t_us >= h.t).b as seq from h")
def _(v):
    right = v.trades.select("symbol", F.col("t_us").alias("t"), "seq")
    return align.asof_forward(hours_of(v), right, KEY, "t", ["seq"], tie="seq", width=HOUR)


@query("j4_asof_backward", "trades", f", {HOURS} select h.symbol, h.t, (select max(struct_pack(a := t.t_us, b := t.seq)) from v_trades t where t.symbol = h.symbol and t.t_us <= h.t).b as seq from h")
def _(v):
    right = v.trades.select("symbol", F.col("t_us").alias("t"), "seq")
    return align.asof_backward(hours_of(v), right, KEY, "t", ["seq"], tie="seq", width=HOUR)


TICK = "case when {p} >= 100 then 0.1 when {p} >= 50 then 0.05 when {p} >= 20 then 0.02 when {p} >= 10 then 0.01 end"


@query("j5_tick_size", "trades", f"select symbol, seq, cast({TICK.format(p='p')} as double) as tick from (select symbol, seq, least(price, 199.0) as p from v_trades) z".replace("0.1 when", "0.1 when"))
def _(v):
    return trades.with_tick_size(v.trades.withColumn("price", F.least("price", F.lit(199.0))), 4).select("symbol", "seq", "tick")


@query("j6_align_series", "series", "select a.day, a.x as x_a, b.x as x_b from v_series a join v_series b on a.day = b.day where a.symbol = 'A' and b.symbol = 'R'")
def _(v):
    s = v.series.select("symbol", "day", "x")
    return bars.align_series(s.filter("symbol = 'A'").drop("symbol"), s.filter("symbol = 'R'").drop("symbol"), ["day"])


@query("j7_merge_features", "trades", "select symbol, bucket, max(buys) as buys, max(sells) as sells, max(volume) as volume from (select symbol, t_us // 600000000 as bucket, count(*) as buys, null::bigint as sells, null::double as volume from v_trades where sign = 1 group by all union all select symbol, t_us // 600000000, null, count(*), null from v_trades where sign = -1 group by all union all select symbol, t_us // 600000000, null, null, sum(qty) from v_trades where sign <> 0 group by all) z group by all")
def _(v):
    t = v.trades.withColumn("bucket", F.expr("t_us div 600000000"))
    n = lambda s, name: t.filter(F.col("sign") == s).groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias(name))
    return bars.merge_features([n(1, "buys"), n(-1, "sells"), t.filter("sign <> 0").groupBy("symbol", "bucket").agg(F.sum("qty").alias("volume"))], ["symbol", "bucket"])


@query("j8_spine", "series", "select s.symbol, s.day, coalesce(v.x, 0) as x from (select symbol, unnest(range(min(day), max(day) + 1)) as day from v_series group by symbol) s left join v_series v on s.symbol = v.symbol and s.day = v.day")
def _(v):
    return bars.with_spine(v.series.select("symbol", F.col("day").cast("bigint").alias("day"), "x"), "day", KEY, {"x": 0.0})


@query("j9_deseasonalize", "series", "select symbol, day, round(x - avg(x) over (partition by symbol, day % 7), 4) as adjusted from v_series")
def _(v):
    return series.deseasonalize(v.series, "x", KEY, F.col("day") % 7).select("symbol", "day", F.round("adjusted", 4).alias("adjusted"))


TOP8 = ", f as (select symbol, side, v, count(*) as n from v_sample group by all), t8 as (select * from (select *, row_number() over (partition by symbol, side order by n desc, v) as rank from f) z where rank <= 8)"


@query("j10_drop_top_values", "sample", TOP8 + "select s.symbol, s.side, count(*) as n, sum(s.v) as total from v_sample s anti join t8 on s.symbol = t8.symbol and s.side = t8.side and s.v = t8.v group by all")
def _(v):
    return distribution.drop_top_values(v.sample, "v", ["symbol", "side"]).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("j11_common_times", "series", "select symbol, day from v_series where symbol = 'A' and day in (select day from v_series where symbol = 'N')")
def _(v):
    s = v.series.select("symbol", "day")
    return bars.common_times(s.filter("symbol = 'A'"), s.filter("symbol = 'N'"), ["day"]).select("symbol", "day")


@query("j12_prior_version", "updates", LIVES + "select symbol, order_id, end_seq as seq, qty as old_qty, side as old_side from lives where end_action in (2, 4, 6)")
def _(v):
    return lives_of(v).filter("end_action in (2, 4, 6)").select("symbol", "order_id", F.col("end_seq").alias("seq"), F.col("qty").alias("old_qty"), F.col("side").alias("old_side"))


@query("j13_window_context", "updates trades", DECREMENTS + "select symbol, center, seq, cast(rank as int) as rank, off as \"offset\" from (select t.symbol, t.seq as center, d.seq, d.t - t.t_us as off, row_number() over (partition by t.symbol, t.seq order by d.t, d.seq) as rank from v_trades t join dec d on t.symbol = d.symbol and abs(d.t - t.t_us) <= 300000000 where t.seq % 100 = 0) z where rank <= 25")
def _(v):
    centers = v.trades.filter("seq % 100 = 0").select("symbol", F.col("seq").alias("center"), F.col("t_us").alias("t"))
    return align.window_context(book.decrement_events(lives_of(v), KEY), centers, 300_000_000, KEY).select("symbol", "center", "seq", "rank", "offset")


@query("j13_window_context_all", "updates trades", DECREMENTS + "select symbol, center, seq, cast(rank as int) as rank, off as \"offset\" from (select t.symbol, t.seq as center, d.seq, d.t - t.t_us as off, row_number() over (partition by t.symbol, t.seq order by d.t, d.seq) as rank from v_trades t join dec d on t.symbol = d.symbol and abs(d.t - t.t_us) <= 300000000) z where rank <= 25")
def _(v):
    """Around every trade, where j13_window_context takes one in a hundred."""
    return align.window_context(book.decrement_events(lives_of(v), KEY), v.trades.select("symbol", F.col("seq").alias("center"), F.col("t_us").alias("t")), 300_000_000, KEY).select("symbol", "center", "seq", "rank", "offset")


# --- aggregations


@query("a1_bucket_time", "trades", "select b.symbol, b.minutes::int as minutes, b.bucket, round(avg(t.price), 6) as mean, count(t.price) as n from (select symbol, m as minutes, unnest(range(min(t_us // (m * 60000000)), max(t_us // (m * 60000000)) + 1)) as bucket from v_trades, (values (10::bigint), (60::bigint)) q(m) group by symbol, m) b left join v_trades t on t.symbol = b.symbol and t.t_us // (b.minutes * 60000000) = b.bucket group by all")
def _(v):
    return r6(bars.bucket_time(v.trades, [10, 60], "price", KEY), "mean")


@query("a2_bucket_events", "trades", "select symbol, i // 50 as bucket, round(avg(price), 6) as mean, count(*) as n from (select symbol, price, row_number() over (partition by symbol order by t_us, seq) - 1 as i from v_trades) z group by all")
def _(v):
    return r6(bars.bucket_events(v.trades, 50, "price", KEY), "mean").withColumn("bucket", F.col("bucket").cast("bigint"))


@query("a3_side_stats", "trades", "select symbol, t_us // 3600000000 as bucket, " + ", ".join(f"round(avg(case when sign = {s} then price end), 6) as px_{n}_mean, round(quantile_cont(case when sign = {s} then price end, 0.9), 6) as px_{n}_p90, count(case when sign = {s} then price end) as px_{n}_count" for s, n in ((1, "bid"), (-1, "ask"))) + " from v_trades group by all")
def _(v):
    t = v.trades.withColumn("bucket", F.expr(f"t_us div {HOUR}")).withColumn("side", F.when(F.col("sign") == 1, 1).when(F.col("sign") == -1, 2))
    return r6(bars.side_stats(t, "price", ["symbol", "bucket"], "px"), "px_bid_mean", "px_bid_p90", "px_ask_mean", "px_ask_p90")


FLOW = "count(price) as trade_count, sum(qty) as trade_volume, sum(signed_qty) as signed_volume, sum(abs(signed_qty)) as abs_signed_volume, round(case when sum(abs(signed_qty)) <> 0 then sum(signed_qty) / sum(abs(signed_qty)) end, 6) as imb_of"


@query("a4_trade_flow", "trades", f"select symbol, t_us // 600000000 as bucket, {FLOW} from v_trades group by all")
def _(v):
    return r6(trades.trade_flow(v.trades.withColumn("bucket", F.expr("t_us div 600000000")), keys=KEY), "imb_of")


@query("a5_micro_features", "updates", EVENTS + "select symbol, t // 86400000000 as bucket, round(avg(ba0 - bb0), 6) as spread_mean, round(avg((ba0 + bb0) / 2), 6) as mid_mean, sum(coalesce((action = 1 and order_type = 2 and side = 1)::int, 0))::bigint as limit_new_bid_count from st2 group by all")
def _(v):
    m = book_events.micro_events(book_events.event_states(v.updates, KEY), lives_of(v), KEY).withColumn("bucket", F.expr(f"t div {DAY}"))
    return r6(bars.micro_features(m, ["symbol", "bucket"]).select("symbol", "bucket", "spread_mean", "mid_mean", "limit_new_bid_count"), "spread_mean", "mid_mean")


TIMEBARS = """, b as (select symbol, t_us // 3600000000 as bar, sum(signed_qty) as signed_volume, sum(qty) as volume, sum(case when sign <> 0 then qty else 0 end) as known_volume from v_trades group by all),
sp as (select symbol, unnest(range(min(bar), max(bar) + 1)) as bar from b group by symbol),
tb as (select sp.symbol, sp.bar, coalesce(signed_volume, 0) as signed_volume, coalesce(volume, 0) as volume, coalesce(known_volume, 0) as known_volume, sp.bar * 3600000000 as bar_us,
  case when volume <> 0 then signed_volume / volume end as imbalance, case when volume <> 0 then known_volume / volume end as known_ratio from sp left join b on sp.symbol = b.symbol and sp.bar = b.bar)
"""


@query("a6_time_bars", "trades", TIMEBARS + "select * replace (round(imbalance, 6) as imbalance, round(known_ratio, 6) as known_ratio) from tb")
def _(v):
    return r6(trades.time_bars(v.trades, 60, KEY), "imbalance", "known_ratio")


@query("a7_count_bars", "trades", """, z as (select *, row_number() over (partition by symbol order by t_us, seq) - 1 as i, count(*) over (partition by symbol) as c from v_trades)
select symbol, i // 20 as block, sum(signed_qty) as signed_volume, sum(qty) as volume, sum(case when sign <> 0 then qty else 0 end) as known_volume, min(t_us) as first_us, max(t_us) as last_us, max_by(price, i) as last_price,
  round(sum(signed_qty) / sum(qty), 6) as imbalance, round(sum(case when sign <> 0 then qty else 0 end) / sum(qty), 6) as known_ratio from z where i // 20 < c // 20 group by all""")
def _(v):
    return r6(trades.count_bars(v.trades, 20, KEY), "imbalance", "known_ratio").withColumn("block", F.col("block").cast("bigint"))


@query("a8_trade_counts", "trades", ", b as (select symbol, t_us // 3600000000 as bar, count(*) filter (sign > 0) as buys, count(*) filter (sign < 0) as sells from v_trades group by all) select s.symbol, s.bar, coalesce(buys, 0) as buys, coalesce(sells, 0) as sells from (select symbol, unnest(range(min(bar), max(bar) + 1)) as bar from b group by symbol) s left join b on s.symbol = b.symbol and s.bar = b.bar")
def _(v):
    return trades.trade_counts(v.trades, 60, KEY)


@query("a9_alignment_stats", "updates trades", DECREMENTS + ", w as (select t.symbol, t.seq, coalesce(sum(d.decrement), 0) as x from v_trades t left join dec d on t.symbol = d.symbol and d.t between t.t_us - 300000000 and t.t_us + 300000000 group by t.symbol, t.seq) select symbol, count(x) as n, round(avg(x), 6) as mean, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.9), 6) as p90, round(quantile_cont(x, 0.99), 6) as p99, round(avg((x = 0)::int), 6) as share_zero from w group by symbol")
def _(v):
    sums = align.window_sums(book.decrement_events(lives_of(v), KEY), v.trades.select("symbol", "seq", F.col("t_us").alias("t")), 300_000_000, KEY)
    return r6(align.alignment_stats(sums, by=KEY), "mean", "median", "p90", "p99", "share_zero")


@query("a10_describe_side", "sample", "select symbol, side, count(v) as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, min(v) as min, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q75, max(v) as max from v_sample group by grouping sets ((symbol, side), (symbol))")
def _(v):
    return r6(distribution.describe_side(v.sample, "v", KEY), "mean", "std").drop("skew", "kurtosis")


@query("a11_hour_histogram", "trades", ", r as (select min(price) as lo, max(price) as hi from v_trades), b as (select (t_us % 86400000000) // 3600000000 as hour, cast(least(98, floor((price - lo) / (hi - lo) * 99)) as int) as bin from v_trades, r) select cast(hour as int) as hour, bin, count(*) as n from b group by grouping sets ((hour, bin), (bin))")
def _(v):
    return distribution.hour_histogram(v.trades, "price", F.hour(F.timestamp_micros("t_us")))


JUMPS = ", o as (select *, lag(price) over (partition by symbol order by t_us, seq) as pp from v_trades where mode = '2'), jm as (select symbol, seq, cast(round_even((price - pp) / cast(case when pp >= 20000 then 50 when pp >= 10000 then 20 when pp >= 5000 then 10 when pp >= 2000 then 5 when pp >= 1000 then 2 when pp >= 500 then 1 when pp >= 200 then 0.5 when pp >= 100 then 0.2 when pp >= 50 then 0.1 else 0.05 end as double), 0) as int) as jump from o where pp is not null)".replace("pp >= 20000 then 50", "pp >= 20000 then 50")


@query("a12_tick_histogram", "trades", JUMPS + "select symbol, jump, count(*) as n from jm where jump between -500 and 500 group by all")
def _(v):
    return trades.tick_histogram(trades.tick_jumps(v.trades, 3, KEY), 500, KEY)


@query("a13_ecdf", "series", "select symbol, x, round(row_number() over (partition by symbol order by x) / count(*) over (partition by symbol), 6) as ecdf from v_series")
def _(v):
    return r6(distribution.ecdf(v.series, "x", KEY), "ecdf")


GAMMA = ", g as (select symbol, side, ln(v / 5) as lv, avg((ln(v / 5) < 0)::int) over (partition by symbol, side) as neg from v_sample), gi as (select symbol, side, neg > 0.1 as raw, case when neg > 0.1 then exp(lv) when lv > 0 then lv end as x from g where (neg > 0.1 and exp(lv) > 0) or (neg <= 0.1 and lv > 0))"


def gamma_of(v):
    return distribution.gamma_input(v.sample.withColumn("lv", F.log(F.col("v") / 5)), "lv", ["symbol", "side"])


@query("a14_gamma_input", "sample", GAMMA + "select symbol, side, case when raw then 'volume' else 'log_volume' end as input, count(*) as n, round(avg(x), 6) as mean from gi group by all")
def _(v):
    return r6(gamma_of(v).groupBy("symbol", "side", "input").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), "mean")


@query("a15_gamma_stats", "sample", GAMMA + "select symbol, side, count(*) as n, round(avg(x), 6) as mean, round(avg(ln(x)), 6) as mean_log from gi group by all")
def _(v):
    return r6(distribution.fit_gamma(gamma_of(v), "x", ["symbol", "side"]).select("symbol", "side", "n", "mean", "mean_log"), "mean", "mean_log")


@query("a15_gamma_fit")
def _(v):
    return distribution.fit_gamma(gamma_of(v), "x", ["symbol", "side"])


@query("a16_ks_stat", "series", ", z as (select symbol, x / avg(x) over (partition by symbol) as y from v_series), o as (select symbol, y, row_number() over (partition by symbol order by y) as i, count(*) over (partition by symbol) as n from z) select symbol, round(max(greatest(i / n - (1 - exp(-y)), 1 - exp(-y) - (i - 1) / n)), 6) as ks, max(n) as n from o group by symbol")
def _(v):
    y = v.series.withColumn("y", F.col("x") / F.avg("x").over(W.partitionBy("symbol")))
    return r6(distribution.ks_stat(y, "y", 1 - F.exp(-F.col("y")), KEY), "ks")


BITS = ", b as (select symbol, day, i, y, lead(y) over (partition by symbol order by day) as nx, " + ", ".join(f"lag(y, {k}) over (partition by symbol order by day) as y{k}" for k in range(1, 6)) + ", count(*) over (partition by symbol) as n from (select symbol, day, row_number() over (partition by symbol order by day) as i, (x > lag(x) over (partition by symbol order by day))::int as y from v_series) a where i > 1), c as (select symbol, i, n, nx, coalesce(y, 0) + " + " + ".join(f"coalesce(y{k}, 0) * {1 << k}" for k in range(1, 6)) + " as code from b), pp as (select symbol, l as length, code % (1 << l) as pattern, count(*) as n_pattern, count(*) / (any_value(n) - l) as p, sum(nx) / count(*) as pi from c, (select unnest(range(1, 7))::int as l) q where i - 1 >= l and nx is not null group by symbol, l, code % (1 << l))"


@query("a17_pattern_probs", "series", BITS + "select symbol, length, pattern, n_pattern, round(p, 6) as p, round(pi, 6) as pi from pp")
def _(v):
    return r6(entropy.pattern_probs(v.series, "x", 6, KEY, "day"), "p", "pi")


@query("a18_pattern_entropy", "series", BITS + ", h as (select symbol, length, -sum(p * (case when pi > 0 then pi * (log2(p) - log2(pi)) else 0 end + case when pi < 1 then (1 - pi) * (log2(p) - log2(1 - pi)) else 0 end)) as e from pp group by symbol, length) select symbol, length, round(e, 6) as entropy, round(greatest(0, 1 + coalesce(lag(e) over (partition by symbol order by length), 1) - e), 6) as information from h")
def _(v):
    return r6(entropy.pattern_entropy(entropy.pattern_probs(v.series, "x", 6, KEY, "day"), KEY), "entropy", "information")


@query("a18_information_half_life", "series", BITS + ", h as (select symbol, length, -sum(p * (case when pi > 0 then pi * (log2(p) - log2(pi)) else 0 end + case when pi < 1 then (1 - pi) * (log2(p) - log2(1 - pi)) else 0 end)) as e from pp group by symbol, length), g as (select symbol, length, greatest(0, 1 + coalesce(lag(e) over (partition by symbol order by length), 1) - e) as i from h), m as (select *, max(i) over (partition by symbol) as top from g) select symbol, round(max(i), 6) as max_information, min(case when i = top then length end) as max_length, min(case when i > top / 2 then length end) as half_length from m group by symbol")
def _(v):
    return r6(entropy.information_half_life(entropy.pattern_entropy(entropy.pattern_probs(v.series, "x", 6, KEY, "day"), KEY), KEY), "max_information")


@query("a19_lagged_mi", "series", ", b as (select symbol, day, cast(least(9, floor((x - min(x) over s) / (max(x) over s - min(x) over s) * 10)) as int) as b from v_series window s as (partition by symbol)), p as (select symbol, k as lag, lag(b, 1) over w as x1, lag(b, 5) over w as x5, b as y from b, (values (1), (5)) q(k) window w as (partition by symbol, k order by day)), pr as (select symbol, lag, case lag when 1 then x1 else x5 end as x, y from p where case lag when 1 then x1 else x5 end is not null), c as (select symbol, lag, x, y, count(*) as c from pr group by all), d as (select *, sum(c) over (partition by symbol, lag) as n, sum(c) over (partition by symbol, lag, x) as cx, sum(c) over (partition by symbol, lag, y) as cy from c) select symbol, lag, round(sum(c / n * ln(c * n / (cx * cy))), 6) as mi, round(-sum(c / n * ln(c / cx)), 6) as conditional_entropy from d group by all")
def _(v):
    return r6(entropy.lagged_mi(v.series, "x", [1, 5], KEY, "day"), "mi", "conditional_entropy")


@query("a20_mean_reversion", "series", ", z as (select symbol, x, lead(x) over (partition by symbol order by day) as y from v_series), f as (select symbol, x, y, regr_slope(y, x) over s as b, regr_intercept(y, x) over s as a from z where y is not null window s as (partition by symbol)) select symbol, round(any_value(a), 2) as a, round(any_value(b), 6) as b, round(stddev_samp((y - a - b * x) / sqrt(greatest(x, 1e-8))), 4) as sigma from f group by symbol having any_value(b) > 1e-8")
def _(v):
    fit = series.fit_mean_reversion(v.series, "x", KEY, "day")
    return fit.filter("b > 1e-8").select("symbol", F.round("a", 2).alias("a"), F.round("b", 6).alias("b"), F.round("sigma", 4).alias("sigma"))


@query("a21_forecast_metrics", "series", ", z as (select symbol, q, avg(q) over (partition by symbol order by day rows between 5 preceding and 1 preceding) as f, lag(q) over (partition by symbol order by day) as l, row_number() over (partition by symbol order by day) as i, count(*) over (partition by symbol) as n from v_series), t as (select symbol, q, f, lag(q) over (partition by symbol order by i) as l from z where i > floor(0.8 * n) and f is not null) select symbol, round(avg((q - f) * (q - f)), 4) as mse, round(avg(power(ln(1 + q) - ln(1 + f), 2)), 6) as mse_log, round(avg(case when l is not null then (sign(q - l) = sign(f - l))::int end), 6) as sign_hit, count(*) as n from t group by symbol")
def _(v):
    w = W.partitionBy("symbol").orderBy("day")
    test = series.time_split(v.series.withColumn("f", F.avg("q").over(w.rowsBetween(-5, -1))), KEY, "day").filter("not train")
    return r6(series.forecast_metrics(test, "q", "f", KEY, "day"), "mse_log", "sign_hit").withColumn("mse", F.round("mse", 4))


@query("a22_time_range", "trades", "select symbol, count(*) as n, min(t_us) as first, max(t_us) as last from v_trades group by symbol")
def _(v):
    return distribution.time_range(v.trades, "t_us", KEY)


@query("a23_sample_per_group", "updates", "select * from v_updates qualify row_number() over (partition by order_type order by md5('0|' || symbol || '|' || seq), symbol, seq) <= 5")
def _(v):
    return distribution.sample_per_group(v.updates, "order_type", 5, ["symbol", "seq"])


@query("a24_distinct_values", "trades", "select distinct (t_us % 86400000000) // 3600000000 as hour from v_trades")
def _(v):
    return v.trades.select(F.expr(f"(t_us % {DAY}) div {HOUR}").alias("hour")).distinct()


@query("a25_density_histogram", "sample", ", r as (select *, min(v) over s as lo, max(v) over s as hi, count(*) over s as c from v_sample window s as (partition by symbol, side)), b as (select symbol, side, cast(least(19, floor((v - lo) / (hi - lo) * 20)) as int) as bin, c, lo, hi from r) select symbol, side, bin, count(*) as n, lo as low, hi as high, round(count(*) * 20 / (c * (hi - lo)), 6) as density from b group by symbol, side, bin, c, lo, hi")
def _(v):
    return r6(distribution.density_histogram(v.sample, "v", ["symbol", "side"], 20), "density")


@query("a25_fitted_curve")
def _(v):
    g = gamma_of(v)
    fits = distribution.fit_gamma(g, "x", ["symbol", "side"]).join(g.groupBy("symbol", "side").agg(F.min("x").alias("low"), F.max("x").alias("high")), ["symbol", "side"])
    return distribution.fitted_curve(fits, "low", "high", ["symbol", "side"])


@query("a26_compare_sides")
def _(v):
    return distribution.compare_sides(distribution.fit_gamma(gamma_of(v), "x", ["symbol", "side"]), KEY)


@query("a27_summary", "trades", " union all ".join(f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, min({c})::double as min, quantile_cont({c}, 0.25)::double as q25, quantile_cont({c}, 0.5)::double as q50, quantile_cont({c}, 0.75)::double as q75, max({c})::double as max from v_trades" for c in ("price", "qty")))
def _(v):
    return r6(distribution.summary(v.trades, ["price", "qty"]), "mean", "std")


# --- windows


@query("w1_status_intervals", "status", "select symbol, event_time_ns as start_ns, lead(event_time_ns) over (partition by symbol order by event_time_ns, md_seq) as end_ns, book_state from v_status")
def _(v):
    return sessions.status_intervals(v.status, KEY, state=["book_state"], merge=False).select("symbol", "start_ns", "end_ns", "book_state")


@query("w2_merged_intervals", "status", SESSION + "select symbol, start as start_ns, stop as end_ns, book_state, (stop - start) / 1e9 as duration_s from k")
def _(v):
    return sessions.status_intervals(v.status, KEY, state=["book_state"]).select("symbol", "start_ns", "end_ns", "book_state", "duration_s")


@query("w3_lag_features", "series", "select symbol, day, x, lag(x, 1) over w as x_lag1, lag(x, 2) over w as x_lag2, lag(x, 5) over w as x_lag5 from v_series window w as (partition by symbol order by day)")
def _(v):
    return bars.add_lags(v.series.select("symbol", "day", "x"), ["x"], [1, 2, 5], KEY, "day")


@query("w4_forward_fill", "trades", ", b as (select symbol, t_us // 3600000000 as bar, max_by(price, seq) as price from v_trades group by all), s as (select symbol, unnest(range(min(bar), max(bar) + 1)) as bar from b group by symbol) select s.symbol, s.bar, last_value(b.price ignore nulls) over (partition by s.symbol order by s.bar rows unbounded preceding) as price from s left join b on s.symbol = b.symbol and s.bar = b.bar")
def _(v):
    return series.last_per_bucket(v.trades.withColumn("bar", F.expr(f"t_us div {HOUR}")), "price", KEY, "bar", "seq").select("symbol", "bar", "price")


@query("w5_log_returns", "series", "select symbol, day, round(x - lag(x) over w, 4) as diff, round(ln(x / lag(x) over w), 6) as log_return from v_series window w as (partition by symbol order by day)")
def _(v):
    return r6(series.log_returns(v.series, "x", KEY, "day").select("symbol", "day", F.round("diff", 4).alias("diff"), "log_return"), "log_return")


@query("w6_tick_jumps", "trades", JUMPS + "select symbol, seq, jump from jm")
def _(v):
    return trades.tick_jumps(v.trades, 3, KEY).select("symbol", "seq", "jump")


@query("w7_event_seconds", "trades", "select symbol, seq, (t_us - min(t_us) over (partition by symbol)) / 1e6 as t_seconds, round((t_us - min(t_us) over (partition by symbol)) / 1e6 + 1e-3 * (row_number() over (partition by symbol, sign, t_us order by seq) - 1), 6) as t_seconds_jitter from v_trades where sign <> 0")
def _(v):
    return r6(trades.event_seconds(v.trades.filter("sign <> 0"), 1e-3, KEY).select("symbol", "seq", "t_seconds", "t_seconds_jitter"), "t_seconds_jitter")


@query("w8_depth_k", "series", "select symbol, day, q + coalesce(case when day % 3 > 0 then x end, 0) as depth, round(ln(1 + q + coalesce(case when day % 3 > 0 then x end, 0)), 6) as log_depth from v_series")
def _(v):
    wide = v.series.select("symbol", "day", F.col("q").alias("q1"), F.when(F.col("day") % 3 > 0, F.col("x")).alias("q2"))
    return r6(series.depth_k(wide, 2).select("symbol", "day", "depth", "log_depth"), "log_depth")


def kl_sql(p: str, q: str, k: int) -> str:
    tp, tq = "(" + " + ".join(f"{p}{j}" for j in range(k)) + ")", "(" + " + ".join(f"{q}{j}" for j in range(k)) + ")"
    inf = " or ".join(f"({p}{j} > 0 and {q}{j} = 0)" for j in range(k))
    return f"case when {inf} then 'infinity'::double else " + " + ".join(f"case when {p}{j} = 0 then 0 else {p}{j} / {tp} * ln(({p}{j} / {tp}) / ({q}{j} / {tq})) end" for j in range(k)) + " end"


def pattern_sql(source: str, value: str, order: str, n: int) -> str:
    return f""", u as (select symbol, {order} as o, row_number() over w as i, coalesce(({value} > lag({value}) over w)::int, 0) as u from {source} window w as (partition by symbol order by {order})),
c as (select *, case when i >= 4 then [0, 2, 1, 3, 4, 1, 5, 0][1 + lag(u, 2) over w * 4 + lag(u, 1) over w * 2 + u] end as c from u window w as (partition by symbol order by o)),
n as (select symbol, o, i, {", ".join(f"sum((c = {j})::int) over (partition by symbol order by o rows between {n - 4} preceding and current row) as n{j}" for j in range(6))} from c),
f as (select *, {", ".join(f"lag(n{j}, {n}) over (partition by symbol order by o) as b{j}, max(case when i = {n} then n{j} end) over (partition by symbol) as f{j}" for j in range(6))} from n)
"""


@query("w9_rolling_pattern_kl", "series", pattern_sql("v_series", "x", "day", 60) + f"select symbol, o as stamp, i::int as row, case when i >= 120 then round({kl_sql('n', 'b', 6)}, 6) end as kl_adjacent, round({kl_sql('n', 'f', 6)}, 6) as kl_first from f where i >= 60")
def _(v):
    return r6(entropy.rolling_pattern_kl(v.series, "x", 60, 6, KEY, "day"), "kl_adjacent", "kl_first")


#: 99th percentile of chi-square with five degrees of freedom.
CHI2_5_99 = 15.086272469388987


@query("w9_change_points", "series", pattern_sql("v_series", "x", "day", 60) + f", z as (select symbol, o as stamp, case when i >= 120 then {kl_sql('n', 'b', 6)} end as a, {kl_sql('n', 'f', 6)} as f from f where i >= 60) select symbol, stamp, round(a, 6) as kl_adjacent, round(f, 6) as kl_first, coalesce(a > {CHI2_5_99} / 57, false) as broke, coalesce(f > {CHI2_5_99} / 114, false) as drifted from z")
def _(v):
    """Windows whose patterns differ from the window before (two samples) or from the first one (one sample) at the 1% level."""
    limit = entropy.kl_thresholds(6, 57, 0.01)
    kl = entropy.rolling_pattern_kl(v.series, "x", 60, 6, KEY, "day")
    rows = entropy.flag_changes(kl, "kl_adjacent", limit["two_sample"]).withColumnRenamed("change", "broke")
    rows = entropy.flag_changes(rows, "kl_first", limit["one_sample"]).withColumnRenamed("change", "drifted")
    return r6(rows.select("symbol", "stamp", "kl_adjacent", "kl_first", "broke", "drifted"), "kl_adjacent", "kl_first")


@query("w10_rolling_binned_kl", "series", f""", o as (select symbol, day, x, row_number() over (partition by symbol order by day) as i from v_series),
e as (select symbol, list_distinct(quantile_cont(x, [0.25, 0.5, 0.75])) as e from o where i <= 100 group by symbol),
b as (select o.*, len(list_filter(e.e, lambda z: z <= o.x)) as b from o join e on o.symbol = e.symbol),
n as (select symbol, day, i, {", ".join(f"sum((b = {j})::int) over (partition by symbol order by day rows between 99 preceding and current row) as n{j}" for j in range(4))} from b),
f as (select *, {", ".join(f"max(case when i = 100 then n{j} end) over (partition by symbol) as f{j}" for j in range(4))} from n)
select symbol, day as stamp, i::int as row, round({kl_sql('n', 'f', 4)}, 6) as kl_first from f where i >= 100 and (i - 100) % 10 = 0""")
def _(v):
    return r6(entropy.rolling_binned_kl(v.series, "x", 4, 100, 10, KEY, "day"), "kl_first")


@query("w11_rank_uniform", "sample", "select symbol, l_orderkey, l_linenumber, round((rank() over (partition by symbol order by v) + (count(*) over (partition by symbol, v) - 1) / 2) / (count(*) over (partition by symbol) + 1), 6) as v_u from v_sample")
def _(v):
    return r6(distribution_ranks(v), "v_u")


def distribution_ranks(v):
    return series.rank_uniform(v.sample, ["v"], KEY).select("symbol", "l_orderkey", "l_linenumber", "v_u")


@query("w12_acf", "series", ", d as (select symbol, day, x - avg(x) over (partition by symbol) as y, row_number() over (partition by symbol order by day) as i from v_series), s as (select symbol, sum(y * y) as ss, count(*) as n from d group by symbol), p as (select a.symbol, k as lag, sum(a.y * b.y) as s from (select unnest(range(0, 11))::int as k) q, d a join d b on a.symbol = b.symbol where a.i = b.i + k group by a.symbol, k) select p.symbol, p.lag, s.n, round(p.s / s.ss, 6) as rho, round(s.n * (s.n + 2) * sum(case when p.lag > 0 then power(p.s / s.ss, 2) / (s.n - p.lag) end) over (partition by p.symbol order by p.lag), 4) as ljung_box_q from p join s on p.symbol = s.symbol")
def _(v):
    return series.acf_ljung_box(v.series, "x", 10, KEY, "day").select("symbol", "lag", "n", F.round("rho", 6).alias("rho"), F.round("ljung_box_q", 4).alias("ljung_box_q"))


@query("k13_ljung_box_p")
def _(v):
    rows = series.acf_ljung_box(v.series, "x", 10, KEY, "day").filter("lag > 0 and lag % 2 = 0").withColumn("q", F.round("ljung_box_q", 4))
    return r6(distribution.with_chi2_p(rows, "q", "lag").select("symbol", "lag", "p_value"), "p_value")


# an even number of degrees of freedom has a finite sum
ORACLE_SQL["k13_ljung_box_p"] = f"""select symbol, lag, round(exp(-max(ljung_box_q) / 2) * sum(pow(ljung_box_q / 2, j) / factorial(j)), 6) as p_value
from ({ORACLE_SQL["w12_acf"]}) q, (select unnest(range(0, 5))::int as j) n where lag > 0 and lag % 2 = 0 and j < lag // 2 group by symbol, lag"""


@query("w13_xcf", "series", ", d as (select symbol, x - avg(x) over s as a, q - avg(q) over s as b, row_number() over (partition by symbol order by day) as i from v_series window s as (partition by symbol)), sc as (select symbol, sqrt(sum(a * a) / count(*)) * sqrt(sum(b * b) / count(*)) as s from d group by symbol) select u.symbol, k as lag, round(avg(u.a * w.b) / any_value(sc.s), 6) as xcf from (select unnest(range(-5, 6))::int as k) q, d u join d w on u.symbol = w.symbol join sc on u.symbol = sc.symbol where u.i = w.i + k group by u.symbol, k")
def _(v):
    return r6(series.xcf(v.series, "x", "q", 5, KEY, "day"), "xcf")


def events_of(v):
    t = trades.event_seconds(trades.clean_trades(v.trades), 1e-3, KEY)
    return t.select("symbol", (F.col("t_seconds_jitter") / 3600).alias("t"), F.when(F.col("sign") == 1, 0).otherwise(1).alias("mark"))


#: events_of in SQL, numbered in time.
POINTS = """, c as (select symbol, sign, seq, t_us, (t_us - min(t_us) over (partition by symbol)) / 1e6 as t_seconds
    from v_trades where mechanism = 1 and mode = '2' and sign in (1, -1)),
  j as (select symbol, (t_seconds + 1e-3 * (row_number() over (partition by symbol, sign, t_us order by seq) - 1)) / 3600 as t from c),
  e as (select symbol, t, row_number() over (partition by symbol order by t) as i from j)"""


@query(
    "w14_excitation",
    "trades",
    POINTS
    + """, s as (select a.symbol, a.i, any_value(a.t) as t, coalesce(sum(exp(2.0 * (b.t - a.t))), 0.0) as state
    from e a left join e b on a.symbol = b.symbol and b.i < a.i group by a.symbol, a.i),
  p as (select symbol, t, state, lag(t) over w as last, lag(state) over w + 1 as after from s window w as (partition by symbol order by i))
select symbol, t, round(state, 6) as state, round(1.0 + 0.3 * 2.0 * state, 6) as intensity,
  round(t - coalesce(last, 0) + 0.3 * coalesce(after, 0) * (1 - exp(-2.0 * (t - coalesce(last, 0)))), 6) as increment from p""",
)
def _(v):
    return r6(hawkes.excitation(events_of(v), KEY, beta=2.0, mu=1.0, alpha=0.3), "state", "intensity", "increment")


@query("w15_dynamic_kde")
def _(v):
    return kde.dynamic_kde(v.series, "x", KEY, "day", h=20000.0, omega=0.99, t0=50, every=60)


@query(
    "k8_density_at",
    "series",
    """, s as (select symbol, x, row_number() over (partition by symbol order by day, x) - 1 as i from v_series),
e as (select symbol, quantile_cont(x, 0.001) as low, quantile_cont(x, 0.999) as high from s group by symbol),
g as (select symbol, m, low - 0.15 * (high - low) + m * 1.3 * (high - low) / 63 as g, 1.3 * (high - low) / 63 as step, case when m in (0, 63) then 0.5 else 1.0 end as half
  from e, (select unnest(range(0, 64))::int as m) q),
k as (select s.symbol, i, m, step * half as part, case when abs(g - x) <= 20000 then 0.75 * (1 - ((g - x) / 20000) ** 2) / 20000 else 0.0 end as k from s join g using (symbol)),
c as (select symbol, i, 0.99 + 0.01 * sum(k * part) as z from k group by symbol, i),
-- what is left at row r of row i: the factors of the rows behind it
a as (select symbol, i, z, sum(case when i >= 50 then ln(0.99 / z) else 0 end) over (partition by symbol order by i) as l from c),
r as (select unnest([49, 50, 120, 400]) as r),
f as (select symbol, m, part, sum(0.99 ** (49 - i) * k) as d from k where i < 50 group by symbol, m, part),
f1 as (select symbol, m, d / sum(d * part) over (partition by symbol) as d from f),
l as (select symbol, r, l from a join r on a.i = r.r),
n as (select k.symbol, r, m, sum(0.01 / z * exp(l.l - a.l) * k) as d from k join a using (symbol, i) join l on l.symbol = k.symbol and k.i <= l.r where i >= 50 group by k.symbol, r, m)
select f1.symbol, l.r as row, f1.m as point, round(20000 * (exp(l.l) * f1.d + coalesce(n.d, 0)), 6) as density
from f1 join l using (symbol) left join n on n.symbol = f1.symbol and n.r = l.r and n.m = f1.m""",
)
def _(v):
    rows = kde.density_at(v.series, "x", KEY, "day", [49, 50, 120, 400], h=20000.0, omega=0.99, t0=50, points=64)
    return r6(rows.select("symbol", "row", "point", (20000 * F.col("density")).alias("density")), "density")


@query("w16_qq_table", "series", "select symbol, q as sample, i::int as i, n, round((i - 0.5) / n, 6) as p, round(-ln(1 - (i - 0.5) / n), 6) as theoretical from (select symbol, q, row_number() over (partition by symbol order by q) as i, count(*) over (partition by symbol) as n from v_series) z")
def _(v):
    return r6(distribution.qq_table(v.series, "q", "exp", KEY), "p", "theoretical")


@query(
    "w17_intensity_at",
    "trades",
    POINTS
    + """, g as (select symbol, i, top * i / 499 as t from (select symbol, max(t) as top from e group by symbol) z, (select unnest(range(0, 500))::int as i) q)
select g.symbol, g.i, round(any_value(g.t), 6) as t, round(1.0 + 0.3 * 2.0 * coalesce(sum(exp(2.0 * (e.t - g.t))), 0.0), 6) as intensity
from g left join e on e.symbol = g.symbol and e.t <= g.t group by g.symbol, g.i""",
)
def _(v):
    return r6(hawkes.intensity_at(events_of(v), KEY, beta=2.0, mu=1.0, alpha=0.3, n=500), "t", "intensity")


# --- order and sets


@query("o1_ordered", "status", "select symbol, md_seq, cast(row_number() over (partition by symbol order by event_time_ns, md_seq) as int) as i from v_status")
def _(v):
    return v.status.select("symbol", "md_seq", F.row_number().over(C.ordered(KEY, "event_time_ns", "md_seq")).alias("i"))


@query("o2_top_levels", "updates", TOP + "select symbol, t, side, cast(level as int) as level, price, qty from rk where level <= 2")
def _(v):
    return book.depth_cumulative(levels_of(v), ["symbol", "t"], 2).select("symbol", "t", "side", "level", "price", "qty")


@query("o3_top_values", "sample", TOP8 + "select symbol, side, v, n, cast(rank as int) as rank from t8")
def _(v):
    return distribution.top_values(v.sample, "v", ["symbol", "side"])


@query("o4_main_session", "status", SESSION + "select symbol, start, stop as \"end\" from s")
def _(v):
    return sessions_of(v)


@query("o5_best_candidate", "trades", """, c as (select symbol, floor(price / 25) as h, (qty::int % 7)::double as omega, round(avg(price), 0) as objective from v_trades group by all)
select symbol, h, omega, objective from (select *, row_number() over (partition by symbol order by objective, h, omega) as r from c) z where r = 1""")
def _(v):
    """Candidates are cells of price and size, their objective a rounded mean, so that many tie."""
    cells = v.trades.groupBy("symbol", F.floor(F.col("price") / 25).cast("double").alias("h"), (F.col("qty").cast("int") % 7).cast("double").alias("omega")).agg(F.round(F.avg("price"), 0).alias("objective"))
    return kde.best_candidate(cells, KEY)


@query("o6_limit", "trades", "select symbol, seq, price from v_trades order by price desc, seq limit 50")
def _(v):
    return C.limit_rows(v.trades.select("symbol", "seq", "price"), [F.desc("price"), "seq"], 50)


@query("u1_merge_marked", "trades", "select symbol, seq, 0 as mark from v_trades where sign = 1 union all select symbol, seq, 1 from v_trades where sign = -1")
def _(v):
    buy, sell = trades.split_sides(v.trades)
    return trades.merge_marked(buy, sell).select("symbol", "seq", "mark")


@query("u2_intersect_times", "series", "select day from v_series where symbol = 'A' intersect select day from v_series where symbol = 'R'")
def _(v):
    return v.series.filter("symbol = 'A'").select("day").intersect(v.series.filter("symbol = 'R'").select("day"))


@query("u3_except_values", "sample", TOP8 + "select s.symbol, s.side, s.v, count(*) as n from v_sample s anti join t8 on s.symbol = t8.symbol and s.side = t8.side and s.v = t8.v group by all")
def _(v):
    return distribution.drop_top_values(v.sample, "v", ["symbol", "side"]).groupBy("symbol", "side", "v").agg(F.count(F.lit(1)).alias("n"))


@query("u4_split_sides", "trades", "select 'buy' as part, count(*) as n, sum(qty) as qty from v_trades where sign = 1 union all select 'sell', count(*), sum(qty) from v_trades where sign = -1")
def _(v):
    total = lambda d, n: d.agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty")).select(F.lit(n).alias("part"), "n", "qty")
    buy, sell = trades.split_sides(v.trades)
    return total(buy, "buy").unionByName(total(sell, "sell"))


# --- kernels


@query("k1_fit_hawkes_uni")
def _(v):
    return hawkes.fit_hawkes_uni(events_of(v), KEY)


@query("k2_fit_hawkes_sym")
def _(v):
    return hawkes.fit_hawkes_sym(events_of(v), KEY, 2.0)


@query("k3_fit_hawkes_sym_full")
def _(v):
    return hawkes.fit_hawkes_sym_full(events_of(v), KEY)


@query("k4_hawkes_change_test")
def _(v):
    return hawkes.hawkes_change_test(events_of(v), KEY, "uni")


@query("k4_change_sym")
def _(v):
    return hawkes.hawkes_change_test(events_of(v), KEY, "sym", beta=2.0)


@query("k4_change_sym_full")
def _(v):
    return hawkes.hawkes_change_test(events_of(v), KEY, "sym_full")


@query("k5_rescaling_sym")
def _(v):
    return hawkes.rescaling_summary(hawkes.rescaling_sym(events_of(v), KEY, 2.0), [*KEY, "mark"])


@query("k5_rescaling")
def _(v):
    return hawkes.rescaling_summary(hawkes.rescaling(events_of(v), KEY), KEY)


#: Replicates of the bootstraps that use it.
BOOT = 100


@query("k6_hawkes_bootstrap")
def _(v):
    return hawkes.hawkes_bootstrap(events_of(v), KEY, replicates=BOOT, block=5)


@query("k6_bootstrap_sym")
def _(v):
    return hawkes.hawkes_bootstrap(events_of(v), KEY, replicates=BOOT, block=5, model="sym", beta=2.0)


@query("k6_bootstrap_sym_full")
def _(v):
    return hawkes.hawkes_bootstrap(events_of(v), KEY, replicates=BOOT, block=5, model="sym_full")


@query("k6_bootstrap_fixed_design")
def _(v):
    return hawkes.hawkes_bootstrap(events_of(v), KEY, replicates=BOOT, block=5, method="fixed_design", model="sym", beta=2.0)


@query("k6_bootstrap_daily")
def _(v):
    events = series.return_events(v.series, 0.3, "abs_gt", "x", KEY, "day").select("symbol", (F.col("t_index") + 1).cast("double").alias("t"))
    return hawkes.hawkes_bootstrap(events, KEY, replicates=BOOT, block=5, restarts=3)


@query("k7_parametric_bootstrap")
def _(v):
    return hawkes.hawkes_bootstrap(events_of(v), KEY, replicates=BOOT, block=5, method="parametric")


@query("k8_select_kde")
def _(v):
    weekly = v.series.groupBy("symbol", F.expr("day div 7").alias("week")).agg(F.sum("x").alias("x"))
    return kde.best_candidate(kde.select_kde(weekly, "x", KEY, "week", t0=40, nu=10, n_h=4, n_omega=4), KEY)


@query("k8_select_series")
def _(v):
    return kde.best_candidate(kde.select_kde(v.series, "x", KEY, "day", t0=100), KEY)


@query("k9_xcf_null")
def _(v):
    from ..operators.causal import xcf_null

    return xcf_null(v.series, "x", "q", KEY, "day")


@query("k10_adf_test")
def _(v):
    return stationarity.adf_test(v.series, "x", KEY, "day")


@query("k12_causal_graph")
def _(v):
    from ..operators.causal import causal_graph

    buckets = v.series.groupBy("symbol", F.expr("day div 21").alias("bucket")).agg(F.sum("x").alias("x"), F.avg("q").alias("q"))
    return causal_graph(bars.causal_dataset(buckets, ["x", "q"], [1, 2], KEY), ["x", "q", "x_lag1", "q_lag1", "x_lag2"], keys=KEY)


# --- streams: a written table read as a stream, run to its end, and its sink read back


STORE = "spark.sql.streaming.stateStore.providerClass"


def streamed(df: DataFrame, job, tag: str, *more: DataFrame, maps: bool = False) -> DataFrame:
    """`df`, then each of `more`, written as files and sent through a stream job, each in a run that goes on from the one before.

    `maps` runs the stream on the state store that holds maps and timers; the session's own setting comes back afterwards.
    """
    from uuid import uuid4

    from ..streaming.stateful import ROCKSDB

    spark = df.sparkSession
    base = f"{scratch(spark)}/stream-{tag}-{uuid4().hex}"
    for part in (df, *more):
        part.select(*df.columns).write.mode("append").parquet(f"{base}/in")
        out = job(spark.readStream.schema(df.schema).parquet(f"{base}/in"))
        before = spark.conf.get(STORE, None)
        if maps:
            spark.conf.set(STORE, ROCKSDB)
        run = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        if maps:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


#: Rows, about, of a delivery to a live book: a key's rows of one micro-batch are held in one task.
DELIVERY = 2_000_000


def slices(df: DataFrame, order: str, most: int) -> list[DataFrame]:
    """The rows as a written table, in deliveries that follow one another in `order` and have some `most` rows each."""
    spark = df.sparkSession
    table, _ = written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order), "deliveries")
    parts = -(-table.count() // most)
    if parts < 2:
        return [table]
    ends = sorted({int(x) for x in table.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts)})
    first = table.filter((F.col(order) <= ends[0]) | F.col(order).isNull())
    return [first, *[table.filter((F.col(order) > a) & (F.col(order) <= b)) for a, b in zip(ends, ends[1:])], table.filter(F.col(order) > ends[-1])]


def timed(df: DataFrame, t: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(t))


@query("t1_stream_bars", "trades", "select symbol, t_us // 3600000000 as bar, sum(signed_qty) as signed_volume, sum(qty) as volume, round(sum(signed_qty) / sum(qty), 6) as imbalance from v_trades where t_us // 3600000000 < (select (max(t_us) - 60000000) // 3600000000 from v_trades) group by all")
def _(v):
    from ..streaming.jobs import stream_bars

    bars_ = streamed(timed(v.trades, "t_us"), lambda s: stream_bars(s, "1 hour", "1 minute", KEY), "bars")
    return r6(bars_.select("symbol", F.expr(f"unix_micros(bar) div {HOUR}").alias("bar"), "signed_volume", "volume", "imbalance"), "imbalance")


PANES = """, p as (select symbol, (price >= 30)::int + (price >= 60)::int + (price >= 120)::int as bin, t_us // 1800000000 as pane, count(*) as c from v_trades group by all),
w as (select symbol, bin, pane - k as s, sum(c) as c from p, (select unnest(range(0, 2)) as k) q group by all)
"""
CLOSED = " where (s + 2) * 1800000000 <= (select max(t_us) - 60000000 from v_trades)"


def binned(v, tag):
    from ..streaming.jobs import stream_binned_counts

    return streamed(timed(v.trades, "t_us").withColumn("value", F.col("price")), lambda s: stream_binned_counts(s, [30.0, 60.0, 120.0], "1 hour", "30 minutes", "1 minute", KEY), tag)


@query("t2_stream_binned_counts", "trades", PANES + "select symbol, bin, s as start, c from w" + CLOSED)
def _(v):
    return binned(v, "counts").select("symbol", "bin", F.expr("unix_micros(start) div 1800000000").alias("start"), "c")


DRIFT = PANES + """,
ref as (select symbol, bin, sum(c) / sum(sum(c)) over (partition by symbol) as q from p group by symbol, bin),
n as (select symbol, s, sum(c) as n from w group by symbol, s)
select w.symbol, s as start, round(sum(c / n * ln(c / n / q)), 6) as kl from w join n using (symbol, s) join ref using (symbol, bin)""" + CLOSED + " group by w.symbol, s"


@query("t2_stream_drift", "trades", DRIFT)
def _(v):
    from ..streaming.jobs import binned_kl

    bin_ = sum(((F.col("price") >= e).cast("int") for e in (60.0, 120.0)), (F.col("price") >= 30.0).cast("int"))
    share = F.col("c") / F.sum("c").over(W.partitionBy("symbol"))
    reference = v.trades.groupBy("symbol", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c")).select("symbol", "bin", share.alias("q"))
    out = binned_kl(binned(v, "drift"), reference, KEY)
    return r6(out.select("symbol", F.expr("unix_micros(start) div 1800000000").alias("start"), "kl"), "kl")


@query("t2_drift_in_stream", "trades", DRIFT)
def _(v):
    """As t2_stream_drift, but the entropies come out of the stream's own sink; the trades come in three deliveries in time."""
    from ..streaming.jobs import stream_drift

    bin_ = sum(((F.col("price") >= e).cast("int") for e in (60.0, 120.0)), (F.col("price") >= 30.0).cast("int"))
    share = F.col("c") / F.sum("c").over(W.partitionBy("symbol"))
    reference = v.trades.groupBy("symbol", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c")).select("symbol", "bin", share.alias("q"))
    rows = timed(v.trades, "t_us").withColumn("value", F.col("price"))
    low, high = v.trades.agg(F.min("t_us"), F.max("t_us")).first()
    part = F.expr(f"(t_us - {low}) * 3 div {high - low + 1}")
    first, *more = (rows.filter(part == i) for i in range(3))
    out = streamed(first, lambda s: stream_drift(s, [30.0, 60.0, 120.0], reference, "1 hour", "30 minutes", "1 minute", KEY), "instream", *more)
    return r6(out.select("symbol", F.expr("unix_micros(start) div 1800000000").alias("start"), "kl"), "kl")


@query("t3_stream_intervals", "status", SESSION + "select symbol, start as start_ns, stop as end_ns, book_state from k where stop is not null")
def _(v):
    from ..streaming.jobs import stream_intervals

    return streamed(v.status, lambda s: stream_intervals(s, ["book_state"], KEY), "intervals")


@query(
    "t3_ordered_intervals",
    "status",
    SESSION + """select symbol, start as start_ns, stop as end_ns, book_state from k
where stop // 1000000 <= (select max(event_time_ns) // 1000000 - 21600000 from v_status)""",
)
def _(v):
    """The rows come up to three hours late, in four deliveries that overlap in time; the stream waits for six."""
    from ..streaming.stateful import ordered_intervals

    late = v.status.withColumn("arrival", F.col("event_time_ns") + F.pmod(F.xxhash64("md_seq"), F.lit(3 * HOUR * 1000)))
    low, high = late.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.least(F.expr(f"(arrival - {low}) * 4 div {high - low + 1}"), F.lit(3))
    first, *more = (late.filter(part == i).drop("arrival") for i in range(4))
    return streamed(first, lambda s: ordered_intervals(s, ["book_state"], "6 hours", KEY), "ordered", *more, maps=True)


BOOK_OUTPUTS = EVENTS + """, b as (select symbol, seq, 1 as side, bb as best from st2 where bb is not null union all select symbol, seq, 2, ba from st2 where ba is not null)
select symbol, seq, 'rlop' as kind, side, round(d, 6) as value from (
  select *, case when side = 1 then bb0 - price else price - ba0 end as d from st2
  where action = 1 and order_type = 2 and price is not null and bb0 is not null and ba0 is not null) z where d > 0
union all
select symbol, seq, 'vol', side, round(abs(ln(best / last)), 6) from (
  select *, lag(best) over (partition by symbol, side order by seq) as last from b) z where last is not null"""


@query("t4_stream_outputs", "updates", BOOK_OUTPUTS)
def _(v):
    """The updates in two deliveries, each in slices; the second brings a part of the first's again, late, which are dropped."""
    from ..streaming.stateful import book_outputs, book_states

    rows = v.updates.join(v.updates.groupBy(*KEY).agg((F.max("seq") / 2).alias("half")), KEY)
    early, late = rows.filter("seq <= half").drop("half"), rows.filter("seq > half or action = 1").drop("half")
    first, *more = slices(early, "seq", DELIVERY) + slices(late, "seq", DELIVERY)
    out = streamed(first, lambda s: book_outputs(book_states(s, KEY), KEY), "outputs", *more, maps=True)
    return r6(out.select("symbol", "seq", "kind", "side", "value"), "value")


@query("t4_stream_book", "updates", EVENTS + "select symbol, seq, bb as best_bid, ba as best_ask, bb0 as best_bid_before, ba0 as best_ask_before from st2")
def _(v):
    from ..streaming.jobs import stream_book

    first, *more = slices(v.updates, "seq", DELIVERY)
    out = streamed(first, lambda s: stream_book(s, KEY), "book", *more)
    return out.select("symbol", "seq", "best_bid", "best_ask", "best_bid_before", "best_ask_before")


@query("t5_stream_recovery", "updates", EVENTS + "select symbol, seq, bb as best_bid, ba as best_ask from st2")
def _(v):
    """The updates in two deliveries; the second brings all of the first's retransmissions again, late, which are dropped."""
    from ..streaming.jobs import stream_book

    top = v.updates.groupBy(*KEY).agg((F.max("seq") / 2).alias("half"))
    rows = v.updates.join(top, KEY)
    early, late = rows.filter("seq <= half").drop("half"), rows.filter("seq > half or action = 5").drop("half")
    out = streamed(early, lambda s: stream_book(s, KEY, on_retransmit="reset"), "recovery", late)
    return out.select("symbol", "seq", "best_bid", "best_ask")


@query("t6_dedupe_updates", "updates", "select symbol, seq, action from v_updates")
def _(v):
    from ..streaming.jobs import dedupe_updates

    twice = timed(v.updates, "t").unionByName(timed(v.updates, "t"))
    return streamed(twice, lambda s: dedupe_updates(s, "10 minutes", ["symbol", "seq"]), "dedupe").select("symbol", "seq", "action")


@query("t7_enrich", "trades", "select symbol, seq, case when symbol % 2 = 0 then 'even' else 'odd' end as kind from v_trades")
def _(v):
    from ..streaming.jobs import enrich

    dim = v.trades.select("symbol").distinct().withColumn("kind", F.when(F.col("symbol") % 2 == 0, "even").otherwise("odd"))
    return streamed(v.trades, lambda s: enrich(s, [(dim, ["symbol"])]), "enrich").select("symbol", "seq", "kind")


# --- sources: the canonical inputs written in each file format and read back


def landed(df: DataFrame, tag: str, kind: str = "text", **options) -> str:
    from uuid import uuid4

    path = f"{scratch(df.sparkSession)}/{tag}-{uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


def text_or_empty(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


@query("s1_order_updates", "updates", "select symbol as symbol_index, seq as md_seq, t * 1000 as event_time_ns, action, priority, prev_priority, order_type, price, side, qty from v_updates")
def _(v):
    from ..sources.readers import read_order_updates

    group = F.concat(F.lit("{"), F.concat_ws(",", *[text_or_empty(c) for c in ("symbol", "action", "priority", "prev_priority", "order_type", "price", "side", "qty")]), F.lit(",}"))
    lines = v.updates.select(F.concat_ws(",", F.col("seq").cast("string"), F.lit("OrderUpdate,0,1"), (F.col("t") * 1000).cast("string"), F.concat(F.lit("[1,"), group, F.lit("]"))).alias("value"))
    return read_order_updates(v.spark, landed(lines, "updates")).select("symbol_index", "md_seq", "event_time_ns", "action", "priority", "prev_priority", "order_type", "price", "side", "qty")


@query("s2_market_status", "status", "select symbol as symbol_index, md_seq, event_time_ns, book_state, trading_period, 1 as session, 0 as phase_qualifier from v_status")
def _(v):
    from ..sources.readers import read_market_status

    group = F.concat_ws(",", F.lit("0"), *[text_or_empty(c) for c in ("symbol", "event_time_ns", "book_state", "status_reason")], F.lit(""), text_or_empty("trading_period"), F.lit(",,,,0,,"))
    lines = v.status.select(F.concat(F.col("md_seq").cast("string"), F.lit(",MarketStatusChange,0,1,[1,{"), group, F.lit("}]")).alias("value"))
    return read_market_status(v.spark, landed(lines, "status")).select("symbol_index", "md_seq", "event_time_ns", "book_state", "trading_period", "session", "phase_qualifier")


def trade_lines(v) -> DataFrame:
    bits = F.when(F.col("sign") > 0, "0,0,0,1,0,0,0,0").when(F.col("sign") < 0, "0,0,1,0,0,0,0,0").otherwise("0,0,0,0,0,0,0,0")
    head = F.concat_ws(",", F.col("seq").cast("string"), F.lit("FullTradeInformation,0,1"), (F.col("t_us") * 1000).cast("string"), F.col("symbol").cast("string"), F.lit(",,,,,"), F.col("price").cast("string"), F.col("qty").cast("string"))
    middle = F.concat(F.lit("," * 7), F.lit(",1,"), F.col("mode"), F.lit("," * 13), F.lit("[1,{"), bits, F.lit("}]"))
    return v.trades.select(F.concat(head, middle, F.lit("," * 10), F.lit("XPAR,,,,")).alias("value"))


@query("s3_full_trades", "trades", "select seq, t_us * 1000 as t_ns, symbol, price, qty, sign, mode, 'XPAR' as venue from v_trades")
def _(v):
    from ..sources.readers import read_full_trades

    df = trades.with_trade_sign(read_full_trades(v.spark, landed(trade_lines(v), "trades")), "TradeQualifierSeq", "MiFIDQuantity")
    return df.select(F.col("MarketDataSequenceNumber").alias("seq"), F.col("EventTimeNs").alias("t_ns"), F.col("SymbolIndex").alias("symbol"), F.col("MiFIDPrice").alias("price"), F.col("MiFIDQuantity").alias("qty"), "sign", F.col("MMTTradingMode").alias("mode"), F.col("Venue").alias("venue"))


@query("s4_trades_minimal", "trades", "select t_us * 1000 as event_time_ns, price, qty from v_trades")
def _(v):
    from ..sources.readers import read_trades_minimal

    return read_trades_minimal(v.spark, landed(trade_lines(v), "trades"))


@query("s5_events_csv", "trades", "select seq, t_us from v_trades where seq % 7 <> 0")
def _(v):
    from ..sources.readers import read_events_csv

    stamp = F.when(F.col("seq") % 7 == 0, "no time").otherwise(F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"))
    path = landed(v.trades.select("seq", stamp.alias("at")), "events", "csv", header="true")
    return read_events_csv(v.spark, path, "at", "seq long, at string").select("seq", F.unix_micros("ts").alias("t_us"))


@query("s6_snapshots", "trades", "select t_us, round(ln(qty), 6) as log_volume from v_trades where qty > 0")
def _(v):
    from ..sources.readers import read_snapshots

    path = landed(v.trades.select(F.timestamp_micros("t_us").alias("timestamp"), F.col("qty").alias("bidvolume1")), "snapshots", "parquet")
    return r6(read_snapshots(v.spark, path, "bid").select(F.unix_micros("ts").alias("t_us"), "log_volume"), "log_volume")


@query("s7_depth_wide", "series", "select symbol, day, x as p1, q as q1, x + 1 as p2, q + 1 as q2 from v_series")
def _(v):
    from ..sources.readers import read_depth_wide

    wide = v.series.select(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), "day"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("x").alias("p1"), F.col("q").alias("q1"), (F.col("x") + 1).alias("p2"), (F.col("q") + 1).alias("q2"), "symbol")
    path = landed(wide, "depth", "csv", header="true")
    back = read_depth_wide(v.spark, path).withColumn("day", F.unix_date(F.to_date("ts")))
    return v.series.select("symbol", "day", F.col("x").alias("p1")).join(back, ["day", "p1"]).select("symbol", "day", "p1", "q1", "p2", "q2")


@query("s8_price_series", "series", "select day, x as value from v_series where symbol = 'A' and day between 9500 and 11000")
def _(v):
    from ..sources.readers import read_price_series

    rows = v.series.filter("symbol = 'A'").select(F.date_add(F.lit("1970-01-01").cast("date"), "day").cast("string").alias("Date"), F.col("x").alias("Close"))
    path = landed(rows, "prices", "csv", header="true")
    return read_price_series(v.spark, path, start="1996-01-05", end="2000-02-13").select(F.unix_date("day").alias("day"), "value")


@query("s9_cluster_times", "trades", "select round((t_us - min(t_us) over ()) / 1e6 / 1e5, 6) as t from v_trades where symbol = 1")
def _(v):
    from ..sources.readers import read_cluster_times

    body = v.trades.filter("symbol in (1, 2)").select("symbol", F.concat(F.lit("x\t"), F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("value"), F.col("seq"))
    heads = body.select("symbol").distinct().select("symbol", F.concat(F.lit("c"), F.col("symbol").cast("string"), F.lit("\t0")).alias("value"), F.lit(-1).cast("bigint").alias("seq"))
    lines = body.unionByName(heads).repartition(2, "symbol").sortWithinPartitions("symbol", "seq").select("value")
    return r6(read_cluster_times(v.spark, landed(lines, "clusters"), "c1").select("t"), "t")


@query("s10_sinks", "trades", "select symbol, seq, price, qty from v_trades")
def _(v):
    from uuid import uuid4

    from ..sources.sinks import write_table

    path = f"{scratch(v.spark)}/sink-{uuid4().hex}"
    write_table(v.trades.select("symbol", "seq", "price", "qty"), path, ("symbol",))
    return v.spark.read.schema("seq long, price double, qty double, symbol long").parquet(path).select("symbol", "seq", "price", "qty")


@query("k11_ci_tests")
def _(v):
    from ..operators.causal import ci_tests

    buckets = v.series.groupBy("symbol", F.expr("day div 21").alias("bucket")).agg(F.sum("x").alias("x"), F.avg("q").alias("q"))
    return ci_tests(buckets, KEY, ["x", "q", "bucket"], [(0, 1, []), (0, 1, [2]), (0, 2, []), (1, 2, [0])])


# --- the flagship: bars, drift of their flow, change points


@query("flow_drift", "trades", TIMEBARS + pattern_sql("tb", "imbalance", "bar", 24) + f"select symbol, o as stamp, round({kl_sql('n', 'f', 6)}, 6) as kl_first, {kl_sql('n', 'f', 6)} > 0.3 as change from f where i >= 24")
def _(v):
    imb = trades.time_bars(v.trades, 60, KEY)
    kl = entropy.flag_changes(entropy.rolling_pattern_kl(imb, "imbalance", 24, 6, KEY, "bar"), "kl_first", 0.3)
    return r6(kl.select("symbol", "stamp", "kl_first", "change"), "kl_first")
