"""Probability of backtest overfitting by combinatorially symmetric cross-validation.

Time is cut into blocks once; a block's count, sum and sum of squares of each strategy are
all that its Sharpe ratio on any union of blocks needs, so the returns are read once and not
once for each of the combinations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kept import written


def daily_returns(trades: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(strategy, day, r): mean net return of the trades entered on a day."""
    day = F.date_trunc("day", "entry_time").cast("timestamp_ntz")
    return trades.groupBy(*(keys or []), "strategy", day.alias("day")).agg(F.avg("net_return").alias("r"))


def complete_days(returns: DataFrame) -> DataFrame:
    """The days on which every strategy that has any return has one."""
    n = returns.agg(F.count_distinct("strategy").alias("all"))
    full = returns.where("r is not null").groupBy("day").agg(F.count("*").alias("have")).join(n, F.col("have") == F.col("all")).select("day")
    return returns.join(full, "day", "left_semi")


def overfitting(returns: DataFrame, splits: int = 8) -> DataFrame:
    """One row: pbo, median_logit, n_strategies, n_periods, n_combinations; pbo is null for too few of either.

    Among strategies that tie in sample the first by name wins; out-of-sample ties share their mean rank.
    """
    d = written(complete_days(written(returns.where("r is not null"))))  # both are read several times
    size = d.agg(F.count_distinct("strategy").alias("n_strategies"), F.count_distinct("day").alias("n_periods"))
    even = splits - splits % 2
    days = d.select("day").distinct().withColumn("block", F.ntile(even).over(W.orderBy("day")) - 1)
    centre = d.groupBy("strategy").agg(F.avg("r").alias("c"))  # squares are taken about a strategy's mean
    parts = d.join(days, "day").join(centre, "strategy").withColumn("x", F.col("r") - F.col("c"))
    parts = parts.groupBy("strategy", "block", "c").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    chosen = [(i, list(c)) for i, c in enumerate(combinations(range(even), even // 2))]
    combos = returns.sparkSession.createDataFrame(chosen, "combo int, inside array<int>")
    merged = parts.join(F.broadcast(combos), how="cross").groupBy("combo", "strategy", "c", F.array_contains("inside", F.col("block")).alias("in_sample")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    flat = F.coalesce(var, F.lit(0.0)) <= 1e-24
    merged = merged.withColumn("sharpe", F.when(flat, 0.0).otherwise((F.col("c") + F.col("s") / F.col("n")) / F.sqrt(F.when(~flat, var))))
    pair = merged.groupBy("combo", "strategy").agg(F.max(F.when(F.col("in_sample"), F.col("sharpe"))).alias("i"), F.max(F.when(~F.col("in_sample"), F.col("sharpe"))).alias("o"))
    w = W.partitionBy("combo")
    ties = F.count("*").over(W.partitionBy("combo", "o"))
    rank = (F.rank().over(w.orderBy("o")) + (ties - 1) / 2) / F.count("*").over(w)
    best = pair.withColumns({"rank": rank, "place": F.row_number().over(w.orderBy(F.desc("i"), "strategy"))}).where("place = 1")
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("rank")))
    out = best.select(F.ln(p / (1 - p)).alias("logit")).agg(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.percentile("logit", F.lit(0.5)).alias("median_logit"), F.count("*").alias("n_combinations"))
    enough = (F.col("n_strategies") >= 2) & (F.col("n_periods") >= 2 * splits)
    return size.join(out, how="cross").select(F.when(enough, F.col("pbo")).alias("pbo"), F.when(enough, F.col("median_logit")).alias("median_logit"), "n_strategies", "n_periods", F.when(enough, F.col("n_combinations")).otherwise(0).alias("n_combinations"))
