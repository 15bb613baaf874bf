"""Series in their canonical form: bars, funding and book snapshots.

bars(symbol, timestamp, open, high, low, close, volume, quote_volume, trades, taker_buy_quote),
funding(symbol, timestamp, funding_rate), book(symbol, spread_bps).  Stored series are
Parquet, partitioned by interval and symbol, so that a filter on either prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("open_time", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_quote", "timestamp", "symbol", "interval")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_bars(spark: SparkSession, root: str, interval: str, symbols: list[str] | None = None) -> DataFrame:
    bars = spark.read.parquet(f"{root}/bars").where(F.col("interval") == interval)
    return bars.where(F.col("symbol").isin(symbols)) if symbols is not None else bars


def load_funding(spark: SparkSession, root: str, symbols: list[str] | None = None) -> DataFrame:
    out = spark.read.parquet(f"{root}/funding")
    return out.where(F.col("symbol").isin(symbols)) if symbols is not None else out


def load_book(spark: SparkSession, root: str, symbols: list[str] | None = None) -> DataFrame:
    out = spark.read.parquet(f"{root}/book")
    return out.where(F.col("symbol").isin(symbols)) if symbols is not None else out


def save_bars(bars: DataFrame, root: str, interval: str) -> None:
    bars.withColumn("interval", F.lit(interval)).write.mode("append").partitionBy("interval", "symbol").parquet(f"{root}/bars")


def ohlcv(ticks: DataFrame, symbol: Column, time: Column, order: Column, price: Column, volume: Column, quote: Column, taker: Column) -> DataFrame:
    """Bars from ticks: one aggregation, combined before the shuffle; order is a total order of a bar's ticks."""
    t = ticks.select(symbol.alias("symbol"), time.alias("timestamp"), order.alias("o"), price.alias("p"), volume.alias("v"), quote.alias("q"), taker.alias("t"))
    return t.groupBy("symbol", "timestamp").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum("v").alias("volume"), F.sum("q").alias("quote_volume"), F.count("*").alias("trades"), F.sum("t").alias("taker_buy_quote"),
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items: return flags are symbols, ship dates the days."""
    t, c = table(spark, sf_dir, "lineitem"), F.col
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ohlcv(t, c("l_returnflag"), c("l_shipdate"), key, 100 + c("l_extendedprice") / c("l_quantity") / 1000, c("l_quantity"), c("l_extendedprice"), F.when(c("l_linestatus") == "O", c("l_extendedprice")).otherwise(0.0))


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour bars of events: event types are symbols; gaps stay gaps."""
    t, c = table(spark, sf_dir, "events"), F.col
    price = 100 + 0.1 * c("value")
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return ohlcv(t, c("event_type"), F.window("ts", "15 minutes")["start"], c("ts"), price, F.lit(1.0), price, F.when(even, price).otherwise(0.0))


def funding_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    week = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    return t.groupBy(F.col("l_returnflag").alias("symbol"), week.alias("timestamp")).agg((F.avg("l_discount") - 0.05).alias("funding_rate"))


def book_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("timestamp"), (100 * F.col("l_tax") + 0.0).alias("spread_bps"))


def inventory(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows, first and last timestamp of each series."""
    return bars.groupBy(*keys).agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def days_between(a, b) -> Column:
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 86_400_000_000.0


def flow_coverage(flow: DataFrame, days: int = 90) -> DataFrame:
    """snapshots, span in days, and whether it is long enough to test on, per symbol."""
    out = flow.groupBy("symbol").agg(F.count("*").alias("snapshots"), F.min("timestamp").alias("a"), F.max("timestamp").alias("z"))
    out = out.select("symbol", "snapshots", days_between("a", "z").alias("span_days"))
    return out.withColumn("testable", F.col("span_days") >= days)


def inventory_summary(bars: DataFrame, flow: DataFrame, days: int = 90) -> DataFrame:
    """One row: symbols, bars, longest flow span and progress towards a testable one, in percent."""
    b = inventory(bars).agg(F.count("*").alias("symbols"), F.sum("rows").alias("bars"))
    f = flow_coverage(flow, days).agg(F.max("span_days").alias("max_span_days"), F.sum("snapshots").alias("snapshots"))
    return b.join(f, how="cross").withColumn("progress_pct", F.least(F.lit(100.0), F.col("max_span_days") / days * 100))
