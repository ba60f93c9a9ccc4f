"""Code labels, clocks, ordering and grids: column helpers without shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEYS = ["trade_date", "symbol_index"]

# Labels of the feed's codes.
ACTIONS = {1: "New", 2: "Delete (by Previous Priority)", 3: "Delete All (by side or whole book)", 4: "Modify (no loss of priority)", 5: "Retransmission (full book refresh)", 6: "Modify (loss of priority)"}
SIDES = {1: "Buy", 2: "Sell"}
ORDER_TYPES = {1: "Market", 2: "Limit", 3: "Stop", 4: "Stop Limit", 5: "Market If Touched", 6: "Market to Limit", 7: "Pegged", 8: "Iceberg"}
BOOK_STATES = {1: "Inaccessible", 2: "Closed", 3: "Call", 4: "Uncrossing", 5: "Continuous", 6: "Halted", 8: "Suspended", 9: "Reserved"}
STATUS_REASONS = {0: "Scheduled", 4: "Collars Breach", 7: "Automatic Reopening", 8: "No Liquidity Provider", 11: "Knock-In by Issuer", 12: "Knock-Out by Exchange", 13: "Knock-Out by Issuer", 15: "Action by Market Operations", 20: "New Listing", 21: "Due to Underlying", 22: "Outside of LP quotes"}
PHASE_QUALIFIERS = {0: "No Qualifier", 1: "Call BBO Only", 2: "Trading At Last", 3: "Random Uncrossing", 5: "Trading At Last + Random Uncrossing", 6: "Stressed Market Conditions", 7: "Exceptional Market Conditions", 9: "Random Uncrossing + Stressed", 11: "Trading At Last + Random Uncrossing + Stressed"}
TRADING_PERIODS = {1: "Opening", 2: "Standard", 3: "Closing"}
TRADING_SIDES = {1: "Bid Only", 2: "Offer Only", 3: "PAKO", 4: "Both Sides"}
ORDER_ENTRY_QUALIFIERS = {0: "Disabled", 1: "Enabled", 3: "Cancel Only"}
SCHEDULED_EVENTS = {0: "Cancel Previously Scheduled Event", 1: "Reopening", 3: "Resumption of trading", 12: "Suspension", 13: "Collars Normal", 14: "Collars Wide", 15: "Pre-Expiry", 16: "Closing Price"}
CHANGE_TYPES = {0: "Status Change(s)", 1: "Scheduled Event Notification", 2: "Status Change(s) + Scheduled Event"}


def label_codes(df: DataFrame, col: str, mapping: dict[int, str], unknown: str = "Unknown(%d)", to: str | None = None) -> DataFrame:
    """Add the label of a code: the mapped text, `unknown` formatted with the code, or an empty string for null."""
    pairs = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))])
    code = F.col(col).cast("int")
    text = F.coalesce(F.try_element_at(pairs, code), F.format_string(unknown, code))
    return df.withColumn(to or f"{col}_label", F.when(code.isNull(), F.lit("")).otherwise(text))


def ts_of(ns: Column | str) -> Column:
    """Timestamp (microseconds) of nanoseconds since the epoch."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(5,0)")).cast("bigint"))


def with_times(df: DataFrame, ns_col: str = "event_time_ns", tz: str = "Europe/Paris") -> DataFrame:
    """Add ts, and the UTC and local wall clock as text. Null or zero times give null and empty texts."""
    ok = F.coalesce(F.col(ns_col), F.lit(0)) != 0
    ts = F.when(ok, F.expr(f"timestamp_micros({ns_col} div 1000)"))
    show = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.withColumn("ts", ts).withColumn("time_utc", F.coalesce(F.date_format(F.col("ts"), show), F.lit(""))).withColumn("time_local", F.coalesce(F.date_format(F.from_utc_timestamp("ts", tz), show), F.lit("")))


def ordered(keys: list[str], time: str = "event_time_ns", *ties: str) -> WindowSpec:
    """The order of a key's rows: time, then the feed's sequence. Never a global sort."""
    return Window.partitionBy(*keys).orderBy(time, *(ties or ("md_seq", "group_pos")))


def valid_side(df: DataFrame, col: str = "side") -> DataFrame:
    return df.filter(F.col(col).isNull() | F.col(col).isin(1, 2))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """The listed columns that exist; rows with a null in any go."""
    have = [c for c in cols if c in df.columns]
    return df.select(*have).dropna("any")


def time_of_day_mask(df: DataFrame, start: str, end: str, ts: str = "ts", keys: list[str] = KEYS, closed: bool = True) -> DataFrame:
    """Rows of each key's first day between two times of day; `closed` includes the end minute."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    first = F.min(F.to_date(ts)).over(Window.partitionBy(*keys))
    at = lambda x: int(x.split(":")[0]) * 60 + int(x.split(":")[1] if ":" in x else 0)
    end_ok = minute <= at(end) if closed else minute < at(end)
    return df.withColumn("_first", first).filter((F.to_date(ts) == F.col("_first")) & (minute >= at(start)) & end_ok).drop("_first")


def filter_cutoff(df: DataFrame, until: str = "17:30:00", ts: str = "ts", tz: str = "Europe/Paris") -> DataFrame:
    """Rows whose local time of day is not after `until`, to the microsecond."""
    local = F.date_format(F.from_utc_timestamp(ts, tz), "HH:mm:ss.SSSSSS")
    return df.filter(local <= f"{until}.000000")


def limit_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of an order: a top-k in every task and one merge, not a global sort."""
    return df.orderBy(*order).limit(n)
