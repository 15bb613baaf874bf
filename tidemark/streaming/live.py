"""Extensions for live data: bars from a stream of ticks, and the audit log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def streamed_bars(ticks: DataFrame, every: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """ticks (symbol, ts, price, volume) to bars, each final once the watermark has passed it."""
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    o = F.col("ts")
    g = t.groupBy("symbol", F.window("ts", every).alias("w")).agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("price") * F.col("volume")).alias("quote_volume"), F.count("*").alias("trades"))
    return g.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "quote_volume", "trades")


def tailed_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder of JSON-lines files as they arrive; malformed lines are left out."""
    v = F.from_json("value", "ts string, type string")
    return spark.readStream.text(path).select("value", v.alias("v")).where("v is not null and v.type is not null").select("v.ts", "v.type", "value")
