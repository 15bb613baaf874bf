"""The audit log: JSON lines (ts, type, and any fields), appended and read by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kept import written


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines with their position from 0 in the given total order.

    Range partitions count their own lines and add those of the partitions before; only
    these counts, one a partition, meet in one place.
    """
    ranged = written(lines.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    counts = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = ranged.withColumn("own_", F.row_number().over(W.partitionBy("part_").orderBy(*order)) - 1)
    return own.join(F.broadcast(counts.select("part_", before.alias("before_"))), "part_").withColumn("index", F.col("own_") + F.col("before_")).drop("part_", "own_", "before_")


def event_count(lines: DataFrame) -> DataFrame:
    """One row: n, all lines of the log, malformed ones too."""
    return lines.agg(F.count("*").alias("n"))


def parsed(lines: DataFrame) -> DataFrame:
    """(index, ts, type, value) of the lines that are JSON objects; malformed ones go."""
    v = F.from_json("value", "ts string, type string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("v", v).where(F.col("v").isNotNull() & F.col("v._bad").isNull()).select("index", "v.ts", "v.type", "value")


def read(lines: DataFrame, since: int = 0, limit: int = 500) -> DataFrame:
    """The last `limit` events at or after position `since`, in order of position."""
    return parsed(lines.where(F.col("index") >= since)).orderBy(F.desc("index")).limit(limit).orderBy("index")


def page(lines: DataFrame, since: int = 0, limit: int = 500) -> DataFrame:
    """The first `limit` events at or after `since`: a client that moves on to the last position + 1 skips none."""
    return parsed(lines.where(F.col("index") >= since)).orderBy("index").limit(limit)


def truncated(value: Column, limit: int) -> Column:
    t = F.trim(value)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log with a position by file and place in it."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"))
    return numbered(t, ["f", "s", "m"]).select("index", "value")
