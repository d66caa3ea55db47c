"""Scans: candles from Parquet, CSV and raw API arrays, and the adapters that turn event and order tables into bars.

Schemas are explicit. NaN becomes NULL at the scan. A bar is labelled by its close: `ts` of an hourly bar 10:00 covers [09:00, 10:00)
of open times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ready

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]
KLINE_SCHEMA = T.StructType([T.StructField("open_time", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base", "taker_buy_quote")), T.StructField("trades", T.LongType()), T.StructField("symbol", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating column."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def klines(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """Stored one-minute candles of all symbols; since_ms is pushed to the scan."""
    rows = spark.read.schema(KLINE_SCHEMA).parquet(path)
    return nan_to_null(rows if since_ms is None else rows.where(F.col("open_time") >= since_ms))


def candles_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV candles: header in any case, timestamps ISO or epoch milliseconds, sorted, the last row of a timestamp wins."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = {"timestamp", "open", "high", "low", "close", "volume"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return typed_candles(raw).drop("line")


def typed_candles(raw: DataFrame) -> DataFrame:
    """String columns to timestamp and doubles; keeps the last line of each timestamp."""
    when = F.coalesce(F.timestamp_millis(F.expr("try_cast(timestamp AS BIGINT)")).cast("timestamp_ntz"), F.expr("try_cast(timestamp AS timestamp_ntz)"))
    typed = raw.withColumn("line", F.monotonically_increasing_id() if "line" not in raw.columns else F.col("line")).select("line", when.alias("timestamp"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close", "volume")])
    last = F.max_by(F.struct(*typed.columns), "line").alias("r")
    return typed.groupBy("timestamp").agg(last).select("r.*").orderBy("timestamp")


def kline_arrays(df: DataFrame, column: str = "raw") -> DataFrame:
    """Raw API arrays (JSON, numbers as strings) to typed rows; the forming bar is not told apart here."""
    a = F.from_json(F.col(column), T.ArrayType(T.StringType()))
    names = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]
    kind = lambda n: "bigint" if n in ("open_time", "close_time", "trades") else "double"
    return df.select("*", *[F.get(a, F.lit(i)).cast(kind(n)).alias(n) for i, n in enumerate(names)])


def _bars(df: DataFrame, symbol: Column, ts: Column, price: Column, first: Column, volume: Column, buyer: Column) -> DataFrame:
    rows = df.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("p"), first.alias("o"), volume.alias("v"), buyer.alias("b"))
    buy = F.when(F.col("b"), F.col("v")).otherwise(0.0)
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum("v").alias("volume"), F.sum(F.col("v") * F.col("p")).alias("quote_volume"), F.count("*").alias("trades"),
        F.sum(buy).alias("taker_buy_base"), F.sum(buy * F.col("p")).alias("taker_buy_quote"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars by event type; one partial aggregation, then one shuffle on (symbol, ts)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")
    return _bars(e, F.col("event_type"), hour, F.col("value"), F.struct("ts", "event_id"), F.col("value"), F.col("user_id") % 2 == 0)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority; volume counts orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return _bars(o, F.col("o_orderpriority"), day, F.col("o_totalprice"), F.col("o_orderkey"), F.lit(1.0), F.col("o_custkey") % 2 == 0)


def weekly_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly revenue per supplier: the wide cross-section (symbol, ts, close, volume)."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    week = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    return rows.groupBy(F.col("l_suppkey").alias("symbol"), week.alias("ts")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, p): quality labels with a fixed probability made from the length, to test classification measures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    x = F.ln(F.col("n_chars") + 1.0) - 7.0
    return table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality IS NOT NULL").join(docs, "doc_id").select("doc_id", "source", F.col("quality").alias("y"), F.round(1 / (1 + F.exp(-x)), 4).alias("p"), "n_chars")
