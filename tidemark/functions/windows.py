"""Recursive building blocks over one ordered partition.

All of them share the partitioning (keys) and order given.  Nulls, never NaN, mean missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(keys: list[str], order: str = "timestamp"):
    return W.partitionBy(*keys).orderBy(order)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def change(w, value: Column, n: int = 1) -> Column:
    return ratio(value, F.lag(value, n).over(w)) - 1


#: Rows of a block of ewm(); with four blocks, what is left out is below 1e-24 for alpha of 1/14.
_BLOCK = 256


def ewm(df: DataFrame, w, value: str, alpha: float, least: int, idx: str, keys: list[str], out: str) -> DataFrame:
    """df with the recursive mean  y = alpha * x + (1 - alpha) * y_prev, y_0 = x_0;  null for the first least - 1 rows.

    Linear in the rows: sums with geometric weights within blocks, each block then
    takes what the three before it carry over.  idx counts a key's rows from 0.
    """
    q = 1 - alpha
    j = F.col(idx) % _BLOCK
    first = F.when(F.col(idx) == 0, F.lit(1.0)).otherwise(alpha)
    own = W.partitionBy(*keys, "ewm_block").orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("ewm_block", F.floor(F.col(idx) / _BLOCK))
    d = d.withColumn("ewm_own", F.pow(F.lit(q), j) * F.sum(first * F.col(value) * F.pow(F.lit(1 / q), j)).over(own))
    d = d.withColumn("ewm_last", F.last(F.when(j == _BLOCK - 1, F.col("ewm_own")), ignorenulls=True).over(before))
    carry = [F.coalesce(F.lag("ewm_last", k * _BLOCK).over(w) if k else F.col("ewm_last"), F.lit(0.0)) * q ** (k * _BLOCK) for k in range(3)]
    full = F.col("ewm_own") + F.pow(F.lit(q), j + 1) * (carry[0] + carry[1] + carry[2])
    return d.withColumn(out, F.when(F.col(idx) >= least - 1, full)).drop("ewm_block", "ewm_own", "ewm_last")
