"""Market-status intervals and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import KEYS

STATE = ["book_state", "status_reason", "phase_qualifier", "trading_period", "trading_side", "order_entry_qualifier"]


def status_intervals(events: DataFrame, keys: list[str] = KEYS, time: str = "event_time_ns", seq: str = "md_seq", state: list[str] = STATE, merge: bool = True) -> DataFrame:
    """start_ns, end_ns (null: open), duration_s and the state of each interval; adjacent equal states are one.

    A state lasts to the next event. Nulls in a state equal each other. Ties of time go by sequence.
    """
    w = W.partitionBy(*keys).orderBy(time, seq)
    rows = events.withColumn("_end", F.lead(time).over(w))
    if merge:
        same = F.lag(F.lit(True)).over(w).isNotNull()
        for c in state:
            same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
        rows = rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
        last = F.max_by("_end", F.struct(time, seq))
        rows = rows.groupBy(*keys, "_run").agg(F.min(time).alias("start_ns"), last.alias("end_ns"), *[F.min_by(c, F.struct(time, seq)).alias(c) for c in state], F.min_by(seq, F.struct(time, seq)).alias(seq)).drop("_run")
    else:
        rows = rows.select(*keys, F.col(time).alias("start_ns"), F.col("_end").alias("end_ns"), *state, seq)
    return rows.withColumn("duration_s", (F.col("end_ns") - F.col("start_ns")) / 1e9)


def main_session(intervals: DataFrame, label: str = "book_state_label", text: str = "Continuous", keys: list[str] = KEYS) -> DataFrame:
    """The longest closed interval of each key whose label contains `text`; the earlier one on ties."""
    best = F.max_by(F.struct("start_ns", "end_ns"), F.struct("duration_s", -F.col("start_ns")))
    rows = intervals.filter(F.col(label).contains(text) & F.col("end_ns").isNotNull())
    return rows.groupBy(*keys).agg(best.alias("s")).select(*keys, F.col("s.start_ns").alias("start"), F.col("s.end_ns").alias("end"))


def filter_continuous(df: DataFrame, sessions: DataFrame, t: str = "event_time_ns", keys: list[str] = KEYS) -> DataFrame:
    """Rows inside their key's session, both ends included."""
    return df.join(sessions, keys).filter(F.col(t).between(F.col("start"), F.col("end"))).drop("start", "end")
