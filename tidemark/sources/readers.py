"""Readers: raw message files by built-in text functions, event and price tables, snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GROUP = r"\{([^}]*)\}"


def _field(parts: Column, i: int, kind: str, lenient: bool = True) -> Column:
    """Field i (from 0): trimmed; empty is null, and under the lenient dialect so is `-`, and `1.0` is a whole number."""
    x = F.trim(F.try_element_at(parts, F.lit(i + 1)))
    x = F.when((x == "") | ((x == "-") if lenient else F.lit(False)), None).otherwise(x)
    if kind == "string":
        return x
    if kind in ("int", "bigint"):
        whole = x.try_cast(kind)
        return F.coalesce(whole, x.try_cast("double").try_cast(kind)) if lenient else whole
    return x.try_cast(kind)


def _messages(spark: SparkSession, path, header_fields: int, kind: str) -> DataFrame:
    """Lines `a,b,..,[n,{..},{..}]` of one message type, a row per group; other lines are skipped."""
    pattern = "^" + ",".join(["([^,]+)"] * header_fields) + r",\[\s*(\d+)\s*,(.*)\]\s*$"
    lines = spark.read.text(path).withColumn("source_file", F.input_file_name())
    hit = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern)).select("source_file", *[F.trim(hit(i)).alias(f"h{i}") for i in range(1, header_fields + 1)], hit(header_fields + 1).cast("int").alias("n"), hit(header_fields + 2).alias("body"))
    return rows.filter(F.col("h2") == kind).select("*", F.posexplode(F.regexp_extract_all("body", F.lit(GROUP), F.lit(1))).alias("group_pos", "g")).withColumn("p", F.split("g", ",", -1))


def read_order_updates(spark: SparkSession, path, lenient: bool = True, max_groups: int | None = None) -> DataFrame:
    """Order updates, a row per group. Missing fields are null, extra ones ignored; rows without symbol or action go."""
    rows = _messages(spark, path, 5, "OrderUpdate")
    if max_groups is not None:
        rows = rows.orderBy(F.col("h1").try_cast("bigint"), "group_pos").limit(max_groups)
    kinds = [("symbol_index", "bigint"), ("action", "int"), ("priority", "bigint"), ("prev_priority", "bigint"), ("order_type", "int"), ("price", "double"), ("side", "int"), ("qty", "double"), ("peg_offset", "double")]
    out = rows.select(
        F.col("h1").try_cast("bigint").alias("md_seq"), F.col("h3").try_cast("int").alias("rebroadcast"), F.col("h4").try_cast("int").alias("emm"), F.col("h5").try_cast("bigint").alias("event_time_ns"),
        F.col("n").alias("no_updates"), "group_pos", *[_field(F.col("p"), i, k, lenient).alias(c) for i, (c, k) in enumerate(kinds)], "source_file",
    )
    out = out.filter("symbol_index is not null and action is not null").withColumn("price_key", F.col("price").cast("decimal(18,6)"))
    return out.withColumn("trade_date", F.to_date(F.expr("timestamp_micros(event_time_ns div 1000)")))


def read_market_status(spark: SparkSession, path) -> DataFrame:
    """Market-status changes, a row per group of 14 fields. Null change type, symbol, time and phase are 0; session null or 0 is 1."""
    kinds = [("md_change_type", "int"), ("symbol_index", "bigint"), ("event_time_ns", "bigint"), ("book_state", "int"), ("status_reason", "int"), ("phase_qualifier", "int"), ("trading_period", "int"), ("trading_side", "int"), ("price_limits", "string"), ("quote_spread_multiplier", "string"), ("order_entry_qualifier", "int"), ("session", "int"), ("scheduled_event", "int"), ("scheduled_event_time_ns", "bigint")]
    rows = _messages(spark, path, 4, "MarketStatusChange")
    out = rows.select(F.col("h1").try_cast("bigint").alias("md_seq"), F.col("h3").try_cast("int").alias("rebroadcast"), F.col("h4").try_cast("int").alias("emm"), F.col("n").alias("no_changes"), "group_pos", *[_field(F.col("p"), i, k, False).alias(c) for i, (c, k) in enumerate(kinds)])
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("md_change_type", "symbol_index", "event_time_ns", "phase_qualifier")}
    out = out.withColumns(zero).withColumn("session", F.when(F.coalesce("session", F.lit(0)) == 0, 1).otherwise(F.col("session")))
    return out.withColumn("trade_date", F.to_date(F.expr("timestamp_micros(event_time_ns div 1000)")))


# The fields of a trade message in order.
TRADE_FIELDS = [
    "MarketDataSequenceNumber", "MessageType", "RebroadcastIndicator", "EMM", "EventTimeNs", "SymbolIndex", "TradingDateTimeUtc", "PublicationDateTimeUtc", "TradeType", "MiFIDInstrumentIdType",
    "MiFIDInstrumentId", "MiFIDExecutionId", "MiFIDPrice", "MiFIDQuantity", "MiFIDPriceNotation", "MiFIDCurrency", "MiFIDQtyInMeasurementUnitNotation", "MiFIDQuantityMeasurementUnit", "MiFIDNotionalAmount", "NotionalCurrency",
    "MiFIDClearingFlag", "MMTMarketMechanism", "MMTTradingMode", "MMTTransactionCategory", "MMTNegotiationIndicator", "MMTAgencyCrossTradeIndicator", "MMTModificationIndicator", "MMTBenchmarkIndicator", "MMTSpecialDividendIndicator", "MMTOffBookAutomatedIndicator",
    "MMTContributionToPrice", "MMTAlgorithmicIndicator", "MMTPublicationMode", "MMTPostTradeDeferral", "MMTDuplicativeIndicator", "TradeQualifierSeq", "TransactionType", "EffectiveDateIndicator", "BlockTradeCode", "TradeReference",
    "OriginalReportTimestampNs", "TransparencyIndicator", "CurrencyCoefficient", "PriceMultiplier", "PriceMultiplierDecimals", "Venue", "StartTimeVwap", "EndTimeVwap", "MiFIDEmissionAllowanceType", "MarketOfReferenceMIC",
]
TRADE_TYPES = {"MarketDataSequenceNumber": "bigint", "RebroadcastIndicator": "int", "EMM": "int", "EventTimeNs": "bigint", "SymbolIndex": "bigint", "TradeType": "int", "TransparencyIndicator": "int", "OriginalReportTimestampNs": "bigint", "PriceMultiplierDecimals": "int", "MiFIDPrice": "double", "MiFIDQuantity": "double", "PriceMultiplier": "double", "CurrencyCoefficient": "double"}


def read_full_trades(spark: SparkSession, path) -> DataFrame:
    """Trade messages: the first `[..]` is cut out before the line is split; lines of fewer than 46 fields go."""
    lines = spark.read.text(path)
    seq = F.regexp_extract("value", r"\[[^\]]*\]", 0)
    at = F.instr("value", "[")
    safe = F.when(seq != "", F.concat(F.expr("substring(value, 1, instr(value, '[') - 1)"), F.lit("@@"), F.expr("substring(value, instr(value, '[') + length(regexp_extract(value, '\\\\[[^\\\\]]*\\\\]', 0)))"))).otherwise(F.col("value"))
    del at
    rows = lines.filter("value <> ''").select(seq.alias("s"), F.split(safe, ",", -1).alias("p")).filter(F.size("p") >= 46)

    def field(i, name):
        if name == "TradeQualifierSeq":
            return F.when(F.get("p", F.lit(i)) == "@@", F.col("s")).otherwise(F.get("p", F.lit(i))).alias(name)
        if name in TRADE_TYPES:
            return _field(F.col("p"), i, TRADE_TYPES[name]).alias(name)
        return F.coalesce(F.try_element_at("p", F.lit(i + 1)), F.lit("")).alias(name)

    out = rows.select(*[field(i, n) for i, n in enumerate(TRADE_FIELDS)]).filter("MessageType = 'FullTradeInformation'")
    bits = F.split(F.regexp_extract("TradeQualifierSeq", GROUP, 1), ",")
    names = ["uncrossing", "first_price", "passive_buy", "aggressive_buy", "market_operations", "nav_bps", "nav_currency", "deferred"]
    return out.withColumn("flags", F.struct(*[_field(bits, i, "int").alias(n) for i, n in enumerate(names)]))


def read_trades_minimal(spark: SparkSession, path) -> DataFrame:
    """Time, price and quantity only, from the first 14 fields: what follows may be broken."""
    p = F.split("value", ",", 15)
    rows = spark.read.text(path).select(p.alias("p")).filter((F.size("p") >= 14) & (F.trim(F.get("p", F.lit(1))) == "FullTradeInformation"))
    out = rows.select(_field(F.col("p"), 4, "bigint").alias("event_time_ns"), _field(F.col("p"), 12, "double").alias("price"), _field(F.col("p"), 13, "double").alias("qty"))
    return out.dropna("any")


def read_events_csv(spark: SparkSession, path, ts_col: str, schema: str | None = None) -> DataFrame:
    """A table with time stamps that carry their zone; rows with bad ones go."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.withColumn("ts", F.try_to_timestamp(F.col(ts_col).cast("string"))).filter("ts is not null")


TIME_NAMES = ["timestamp", "time", "ts", "datetime", "date", "time_paris"]


def _pick(columns: list[str], names: list[str]) -> str | None:
    low = {c.lower(): c for c in columns}
    return next((low[n] for n in names if n in low), None)


def read_snapshots(spark: SparkSession, path, side: str, tz: str = "Europe/Paris") -> DataFrame:
    """ts (UTC) and log_volume of one side, whatever the columns are called. Stamps without a zone are local."""
    df = spark.read.parquet(path)
    at = _pick(df.columns, TIME_NAMES)
    logs = _pick(df.columns, [f"log_volume_{side}", f"{side}_log_volume", f"log_{side}volume1", "log_volume"])
    raw = _pick(df.columns, [f"{side}volume1", f"{side}_volume1", f"volume_{side}", f"{side}_volume", "volume"])
    if at is None or (logs is None and raw is None):
        raise ValueError(f"no time or volume column of side {side} among {df.columns}")
    kind = dict(df.dtypes)[at]
    ts = F.to_utc_timestamp(F.col(at).cast("timestamp"), tz) if kind in ("timestamp_ntz", "string", "date") else F.col(at)
    value = F.col(logs) if logs else F.when(F.col(raw) > 0, F.log(raw))
    return df.select(ts.alias("ts"), value.cast("double").alias("log_volume")).dropna("any")


def depth_levels(columns: list[str]) -> int:
    """K of columns p1,q1,..,pK,qK."""
    have = {int(m[1]) for c in columns if (m := re.fullmatch(r"q(\d+)", c))}
    k = 0
    while k + 1 in have:
        k += 1
    return k


def read_depth_wide(spark: SparkSession, path, k: int | None = None, ts_col: str = "timestamp") -> DataFrame:
    """Wide depth rows with K inferred of the column names, as ts, prices and quantities in doubles."""
    df = spark.read.option("header", True).csv(path)
    k = k or depth_levels(df.columns)
    return df.select(F.try_to_timestamp(F.col(ts_col)).alias("ts"), *[F.col(f"{c}{i}").try_cast("double").alias(f"{c}{i}") for i in range(1, k + 1) for c in "pq"]).filter("ts is not null")


def read_price_series(spark: SparkSession, path, value_col: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """day and value of a price file: date and close columns by name, bad numbers and dates go, an optional range."""
    df = spark.read.option("header", True).csv(path)
    at, value = _pick(df.columns, ["date", "datetime", "timestamp", "time"]), value_col or _pick(df.columns, ["close", "adj close", "adj_close", "price", "value"])
    if at is None or value is None:
        raise ValueError(f"no date or price column among {df.columns}")
    rows = df.select(F.to_date(F.try_to_timestamp(F.col(at))).alias("day"), F.col(f"`{value}`").try_cast("double").alias("value")).dropna("any")
    if start:
        rows = rows.filter(F.col("day") >= F.lit(start).cast("date"))
    return rows.filter(F.col("day") <= F.lit(end).cast("date")) if end else rows


def read_cluster_times(spark: SparkSession, path, cluster_id: str, scale: float = 1e5) -> DataFrame:
    """Times of one cluster of a tab-separated file whose header rows (an id and a size) start clusters.

    A file's lines stay in order, so each file is one ordered group.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"), F.split("value", "\t").alias("p"))
    t = F.try_to_timestamp(F.get("p", F.lit(1)))
    rows = rows.withColumn("head", F.when(t.isNull(), F.trim(F.get("p", F.lit(0))))).withColumn("t", t)
    rows = rows.withColumn("cluster", F.last("head", ignorenulls=True).over(W.partitionBy("f").orderBy("i"))).filter((F.col("cluster") == cluster_id) & F.col("t").isNotNull())
    s = F.unix_micros("t") / 1e6
    return rows.select("cluster", ((s - F.min(s).over(W.partitionBy("cluster"))) / scale).alias("t"))
