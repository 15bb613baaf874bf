"""Purged walk-forward folds of many strategies at once.

Trades in order of entry are cut into splits + 1 blocks of n // (splits + 1); fold k tests
block k (the last takes what is left) and trains on what came before, without the trades
that were still open when the test window began (purged) and without the last `embargo`
share before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kept import written
from ..functions.spans import numbered as positions
from .statistics import ORDER, finite, sharpe


def numbered(trades: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """trades with pos, n, block and fold (null before the first test block); groups of fewer than 2 * splits go."""
    t = positions(trades, keys, ORDER, idx="pos").where(F.col("n") >= 2 * splits).withColumn("block", F.floor(F.col("n") / (splits + 1)))
    return t.withColumn("fold", F.when(F.col("pos") >= F.col("block"), F.least(F.floor(F.col("pos") / F.col("block")), F.lit(splits))).cast("int"))


def walk_forward(trades: DataFrame, keys: list[str], splits: int = 6, embargo: float = 0.01) -> DataFrame:
    """A row for each fold: fold (from 0), test_start, test_end, n_train, purged, embargoed, and the test trades' statistics.

    Trades are numbered in spans, written, and counted against the few times at which test windows begin.
    """
    t, r = written(numbered(trades.select(*dict.fromkeys([*keys, *ORDER, "exit_time", "net_return"])), keys, splits)), F.col("net_return")
    test = t.where("fold is not null").groupBy(*keys, "fold").agg(
        F.min("entry_time").alias("test_start"), F.max("exit_time").alias("test_end"), F.max("n").alias("n_all"),
        F.count(F.when(finite(r), 1)).alias("n_trades"), F.avg(F.when(finite(r), (r > 0).cast("double"))).alias("win_rate"), F.avg(F.when(finite(r), r)).alias("mean_return"), F.stddev_samp(F.when(finite(r), r)).alias("sd"),
    )
    starts = t.where("fold is not null").groupBy(*keys).agg(*[F.min(F.when(F.col("fold") == k, F.col("entry_time"))).alias(f"start_{k}") for k in range(1, splits + 1)])
    begun = t.join(starts, keys)
    before = lambda k, late: F.count(F.when((F.col("pos") < k * F.col("block")) & late, 1))
    counts = [F.struct(F.lit(k).alias("fold"), before(k, F.col("exit_time") >= F.col(f"start_{k}")).alias("purged"), before(k, F.col("exit_time") < F.col(f"start_{k}")).alias("left")) for k in range(1, splits + 1)]
    got = begun.groupBy(*keys).agg(F.array(*counts).alias("c")).select(*keys, F.inline("c"))
    out = test.join(got, [*keys, "fold"])
    barred = F.floor(F.col("n_all") * embargo)
    out = out.withColumn("embargoed", F.when((barred > 0) & (F.col("left") > barred), barred).otherwise(0)).withColumn("n_train", F.col("left") - F.col("embargoed"))
    return out.where("n_train > 0").select(*keys, (F.col("fold") - 1).alias("fold"), "test_start", "test_end", "n_train", "purged", "embargoed", "n_trades", "win_rate", "mean_return", sharpe(F.col("mean_return"), F.col("sd"), F.col("n_trades")).alias("sharpe"))


def members(trades: DataFrame, keys: list[str], splits: int = 6, embargo: float = 0.01) -> DataFrame:
    """(keys, fold, role, pos): the train and test rows of each fold, for models that are fitted on them."""
    t = numbered(trades, keys, splits)
    test = t.where("fold is not null").select(*keys, "fold", F.lit("test").alias("role"), "pos")
    first = t.where("fold is not null").groupBy(*keys, "fold").agg(F.min("entry_time").alias("test_start"), F.min("pos").alias("from"), F.max("n").alias("n_all"))
    left = t.select(*keys, "pos", "exit_time").join(first, keys).where((F.col("pos") < F.col("from")) & (F.col("exit_time") < F.col("test_start")))
    back = F.row_number().over(W.partitionBy(*keys, "fold").orderBy(F.desc("pos")))
    size = F.count("*").over(W.partitionBy(*keys, "fold"))
    barred = F.floor(F.col("n_all") * embargo)
    train = left.withColumns({"back": back, "size": size}).where((F.col("back") > barred) | (F.col("size") <= barred))
    return test.unionByName(train.select(*keys, "fold", F.lit("train").alias("role"), "pos")).withColumn("fold", F.col("fold") - 1)


def consistency(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.groupBy(*keys).agg(F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"), F.count(F.when(F.col("sharpe") > 0, 1)).alias("positive_folds"), F.count("*").alias("total_folds"))
