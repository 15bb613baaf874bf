"""Scans along series of any length, in spans of days.

A span is so many days of one key.  What a scan needs of earlier spans is one small row for
each span (a count, a sum, a peak, a last value): these are scanned instead of the rows and
carried into the spans behind them.  So the rows of one key are the work of many tasks, no
window holds a whole series, and nothing is collected or sampled; the plan is lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a span: a few hundred daily bars, some ten thousand of a quarter of an hour.
DAYS = 128
UP_TO_HERE = (W.unboundedPreceding, 0)
BEFORE = (W.unboundedPreceding, -1)


def span(on: str = "timestamp", days: int = DAYS) -> Column:
    """The span of a date or timestamp, rising with it."""
    return F.floor(F.unix_date(F.col(on).cast("date")) / days).cast("int")


def numbered(df: DataFrame, keys: list[str], order: tuple[str, ...] = ("timestamp",), days: int = DAYS, idx: str = "idx", n: str = "n") -> DataFrame:
    """df with idx, a row's position in its key's order from 0, and n, the key's rows; order begins with a time."""
    d = df.withColumn("span_", span(order[0], days))
    counts = d.groupBy(*keys, "span_").agg(F.count("*").alias("c_"))
    w = W.partitionBy(*keys)
    counts = counts.select(*keys, "span_", F.coalesce(F.sum("c_").over(w.orderBy("span_").rowsBetween(*BEFORE)), F.lit(0)).alias("before_"), F.sum("c_").over(w).alias(n))
    d = d.withColumn("own_", F.row_number().over(W.partitionBy(*keys, "span_").orderBy(*order)) - 1)
    return d.join(counts, [*keys, "span_"]).select(*df.columns, (F.col("own_") + F.col("before_")).cast("int").alias(idx), n)


def running_sum(df: DataFrame, keys: list[str], value: str, out: str, on: str = "timestamp", days: int = DAYS) -> DataFrame:
    """df with out, the sum of value up to each row (in order of `on`) of its key; nulls count as 0."""
    d = df.withColumn("span_", span(on, days))
    sums = d.groupBy(*keys, "span_").agg(F.sum(value).alias("s_"))
    sums = sums.select(*keys, "span_", F.coalesce(F.sum("s_").over(W.partitionBy(*keys).orderBy("span_").rowsBetween(*BEFORE)), F.lit(0)).alias("before_"))
    d = d.withColumn("own_", F.coalesce(F.sum(value).over(W.partitionBy(*keys, "span_").orderBy(on).rowsBetween(*UP_TO_HERE)), F.lit(0)))
    return d.join(sums, [*keys, "span_"]).select(*df.columns, (F.col("own_") + F.col("before_")).alias(out))


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], on: str = "timestamp", days: int = DAYS, times=None) -> DataFrame:
    """left with the values of the last row of right at or before it, per key; null before the first.

    One union and one window a (key, span), and no range join.  The last row of each span of
    right is repeated at the beginning of the spans up to right's next one, so that every span
    of left knows what came before.  times: left's last time, or a frame cheaper than left with the same
    one; it says how far right's last row is carried.
    """
    held = F.struct(*[F.col(v) for v in values])
    last_time = times if not isinstance(times, DataFrame) else times.agg(F.max(on)).first()[0]
    if last_time is None:
        last_time = left.agg(F.max(on)).first()[0]
    r = right.select(*keys, F.col(on), held.alias("held_")).withColumn("span_", span(on, days))
    last = r.groupBy(*keys, "span_").agg(F.max_by("held_", on).alias("held_"))
    until = F.floor(F.unix_date(F.lit(last_time).cast("date")) / days).cast("int")
    after = F.coalesce(F.lead("span_").over(W.partitionBy(*keys).orderBy("span_")), F.greatest(until, F.col("span_")))
    carried = last.withColumn("to_", after).where(F.col("to_") > F.col("span_")).select(*keys, F.explode(F.sequence(F.col("span_") + 1, F.col("to_"))).alias("span_"), "held_")
    a = left.select("*", span(on, days).alias("span_"), F.lit(2).alias("side_"))
    more = r.select("*", F.lit(1).alias("side_")).unionByName(carried.select("*", F.lit(0).alias("side_")), allowMissingColumns=True)
    w = W.partitionBy(*keys, "span_").orderBy(on, "side_").rowsBetween(*UP_TO_HERE)  # what is carried has no time and comes first
    both = a.unionByName(more, allowMissingColumns=True).withColumn("last_", F.last("held_", ignorenulls=True).over(w)).where("side_ = 2")
    return both.select(*left.columns, *[F.col(f"last_.{v}").alias(v) for v in values])
