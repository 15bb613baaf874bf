"""Exact order statistics of many groups at once, without a group in one task.

The first digit of a double is its sign, its power of two and a 4096th of the octave that it
lies in; it rises with the value.  Values are counted by digit, in part before the shuffle; sums
of these counts, some thousands a group, say in which digit a rank lies, and only the values
with such a digit are sorted, each digit on its own.  The digit comes from a logarithm, which is
monotonic, so nothing depends on how exact it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 4096
#: Beyond any double's power of two, so that digits of positive values are positive.
_FAR = 1100


def digit(x: Column) -> Column:
    size = F.abs(x)
    own = F.when(size < float("inf"), F.floor(F.log2(size) * STEPS)).otherwise(F.lit(_FAR * STEPS)) + _FAR * STEPS
    return F.when(F.isnan(x), 4 * _FAR * STEPS).when(x == 0, 0).otherwise(F.signum(x) * own).cast("int")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each name in shares): exact quantiles, linear between neighbouring ranks; nulls don't count, NaN is largest.

    df is read twice.  Groups without a value have no row.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x_")).withColumn("g_", digit(F.col("x_")))
    w = W.partitionBy(*keys)
    counts = v.groupBy(*keys, "g_").agg(F.count("*").alias("c_"))
    counts = counts.withColumns({"to_": F.sum("c_").over(w.orderBy("g_").rowsBetween(W.unboundedPreceding, 0)), "n_": F.sum("c_").over(w)})
    place = {name: F.lit(float(p)) * (F.col("n_") - 1) for name, p in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place.values()])))
    held = F.filter(ranks, lambda r: (r < F.col("to_")) & (r >= F.col("to_") - F.col("c_")))
    wanted = counts.withColumn("ranks_", held).where(F.size("ranks_") > 0).select(*keys, "g_", (F.col("to_") - F.col("c_")).alias("from_"), "n_", "ranks_")
    row = F.row_number().over(W.partitionBy(*keys, "g_").orderBy("x_")) - 1 + F.col("from_")
    found = v.join(wanted, [*keys, "g_"]).withColumn("rank_", row).where(F.array_contains("ranks_", F.col("rank_")))
    out = []
    for name, p in place.items():
        lo, hi = (F.max(F.when(F.col("rank_") == f(p), F.col("x_"))) for f in (F.floor, F.ceil))
        at = F.max(p)
        out.append(F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name))
    return found.groupBy(*keys).agg(*out)


def sums_below(df: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """(keys, value, sums, below_...): the sums of rows with each value of a group, and those of all rows with smaller ones."""
    d = df.groupBy(*keys, value).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("g_", digit(F.col(value).cast("double")))
    before = W.partitionBy(*keys).orderBy("g_").rowsBetween(W.unboundedPreceding, -1)
    parts = d.groupBy(*keys, "g_").agg(*[F.sum(c).alias(f"p_{c}") for c in sums])
    parts = parts.select(*keys, "g_", *[F.coalesce(F.sum(f"p_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
    own = W.partitionBy(*keys, "g_").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({f"own_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums})
    return d.join(parts, [*keys, "g_"]).select(*keys, value, *sums, *[(F.col(f"own_{c}") + F.col(f"before_{c}")).alias(f"below_{c}") for c in sums])
