"""Canonical inputs of the registered queries, derived from the test tables by one SQL text for both engines."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

KEY = ["symbol"]

#: What differs between the engines: the clock of events and the day of line items.
BASE = {
    "spark": {"ev": "select event_id, unix_micros(cast(ts as timestamp)) as t_us, user_id, event_type, value from {events}", "li": "select l_returnflag as flag, unix_date(cast(l_shipdate as date)) as day, l_linenumber, l_orderkey, l_quantity, cast(floor(l_extendedprice * 100) as bigint) as cents from {lineitem}"},
    "duck": {"ev": "select event_id, epoch_us(ts) as t_us, user_id, event_type, value from events", "li": "select l_returnflag as flag, (l_shipdate::date - date '1970-01-01')::int as day, l_linenumber, l_orderkey, l_quantity, cast(floor(l_extendedprice * 100) as bigint) as cents from lineitem"},
}

VIEWS = {
    "trades": """
select user_id % 5 as symbol, event_id as seq, t_us, floor((20 + value) * 100) / 100 as price, cast(1 + event_id % 97 as double) as qty,
  case when event_type in ('purchase', 'click') then 1 when event_type in ('error', 'view') then -1 else 0 end as sign,
  cast(case when event_type in ('purchase', 'click') then 1 when event_type in ('error', 'view') then -1 else 0 end * (1 + event_id % 97) as double) as signed_qty,
  case when event_type = 'signup' then '1' else '2' end as mode, 1 as mechanism
from ev""",
    "updates": """
select symbol, event_id as seq, t_us as t, action,
  case when action in (1, 5, 6) then event_id when action = 4 then prev end as priority,
  case when action in (2, 6) then prev end as prev_priority,
  case when event_id % 31 = 0 then 1 else 2 end as order_type,
  cast(case when action = 3 then case when event_id % 2 = 1 then 1 end when action = 4 then 1 + prev % 2 when action <> 2 then 1 + event_id % 2 end as int) as side,
  case when action in (1, 4, 5, 6) and event_id % 31 <> 0 then cast(10000 + (case when (case when action = 4 then prev else event_id end) % 2 = 0 then -1 else 1 end) * (1 + event_id * 7919 % 50) as double) / 100 end as price,
  case when action in (1, 4, 5, 6) then cast(10 + event_id * 13 % 90 as double) end as qty
from (select symbol, event_id, t_us, case event_id % 3 when 0 then l1 when 1 then l2 else l3 end as prev,
    case when event_id % 997 = 0 then 3 when event_id % 2500 between 1200 and 1240 then 5 when event_type in ('signup', 'purchase') then 1 when event_type = 'click' then 4 when event_type = 'view' then 2 else 6 end as action
  from (select user_id % 5 as symbol, event_id, t_us, event_type, lag(event_id, 1) over (partition by user_id % 5 order by event_id) as l1,
      lag(event_id, 2) over (partition by user_id % 5 order by event_id) as l2, lag(event_id, 3) over (partition by user_id % 5 order by event_id) as l3 from ev) x) y""",
    "status": """
select user_id % 5 as symbol, event_id as md_seq, t_us * 1000 as event_time_ns, cast(floor(value) as int) % 3 as book_state, cast(event_id % 2 as int) * 0 as status_reason,
  case when event_type = 'signup' then 1 end as trading_period from ev""",
    "series": "select flag as symbol, day, cast(sum(cents) as double) / 100 as x, cast(sum(l_quantity) as double) as q from li group by flag, day",
    "sample": "select flag as symbol, cast(1 + l_linenumber % 2 as int) as side, l_quantity as v, l_orderkey, l_linenumber from li",
}


class Views:
    """The views as DataFrames of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.spark.sql(BASE["spark"]["ev"], events=self.table("events"))

    @cached_property
    def li(self) -> DataFrame:
        return self.spark.sql(BASE["spark"]["li"], lineitem=self.table("lineitem"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        if "from li" in text:
            return self.spark.sql(text.replace("from li", "from {li}"), li=self.li)
        return self.spark.sql(text.replace("from ev", "from {ev}"), ev=self.ev)


def duck(*names: str) -> str:
    """A WITH clause of the base tables and views named."""
    parts = [f"{k} as ({v})" for k, v in BASE["duck"].items()] + [f"v_{n} as ({VIEWS[n]})" for n in names]
    return "with " + ",\n".join(parts)
