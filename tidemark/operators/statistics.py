"""Trade statistics, deflated Sharpe ratio and the verdict, for any grouping of trades at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.kept import written
from ..functions.normal import best_of, cdf
from ..functions.order import quantiles
from ..functions.spans import BEFORE, UP_TO_HERE, span

ORDER = ("entry_time", "symbol", "entry_idx")
INF = float("inf")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def _log(value: str) -> Column:
    return F.log1p(F.greatest(F.col(value), F.lit(-0.999999)))


def _scanned(trades: DataFrame, keys: list[str], value: str, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(trades with span_, equity s_ and peak m_ since their span began; a row for each span: equity e_ and peak before it, and its own sum, top, low and worst drop)."""
    w = W.partitionBy(*keys, "span_").orderBy(*order).rowsBetween(*UP_TO_HERE)
    t = trades.where(finite(F.col(value))).withColumn("span_", span(order[0]))
    t = t.withColumn("s_", F.sum(_log(value)).over(w)).withColumn("m_", F.max("s_").over(w))
    parts = t.groupBy(*keys, "span_").agg(F.sum(_log(value)).alias("sum_"), F.max("s_").alias("top_"), F.min("s_").alias("low_"), F.min(F.col("s_") - F.col("m_")).alias("worst_"))
    before = W.partitionBy(*keys).orderBy("span_").rowsBetween(*BEFORE)
    parts = parts.withColumn("e_", F.coalesce(F.sum("sum_").over(before), F.lit(0.0)))
    return t, parts.withColumn("peak_", F.max(F.col("e_") + F.col("top_")).over(before))


def drawdown(trades: DataFrame, keys: list[str], value: str = "net_return", order: tuple[str, ...] = ORDER) -> DataFrame:
    """trades with log_equity and drawdown, compounded in log space; the first trade sets the first peak.

    Each span of days is summed on its own; equity and peak are carried into the next ones.
    """
    t, parts = _scanned(trades, keys, value, order)
    d = t.join(parts.select(*keys, "span_", "e_", "peak_"), [*keys, "span_"])
    equity, peak = F.col("e_") + F.col("s_"), F.greatest("peak_", F.col("e_") + F.col("m_"))
    return d.select(*trades.columns, equity.alias("log_equity"), F.expm1(equity - peak).alias("drawdown"))


def max_drawdown(trades: DataFrame, keys: list[str], value: str = "net_return", order: tuple[str, ...] = ORDER) -> DataFrame:
    """(keys, max_drawdown): the worst of each span, against its own peaks and against the peak before it."""
    _, parts = _scanned(trades, keys, value, order)
    return parts.groupBy(*keys).agg(F.expm1(F.min(F.least("worst_", F.col("e_") + F.col("low_") - F.col("peak_")))).alias("max_drawdown"))


def sharpe(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n < 2) | (F.coalesce(sd, F.lit(0.0)) == 0), 0.0).otherwise(mean / F.nullif(sd, F.lit(0.0)))


def trade_statistics(trades: DataFrame, keys: list[str], value: str = "net_return", order: tuple[str, ...] = ORDER) -> DataFrame:
    """Thirteen statistics of each group; profit factor and payoff ratio are infinite without losses.

    log_total_return is the sum that total_return comes from; beyond -37 or 709 only the sum still tells groups apart.
    The trades' returns are written first: drawdown and exact median read them again.
    """
    r = F.col(value)
    t = written(trades.where(finite(r)).select(*dict.fromkeys([*keys, *order, value])))
    win, loss = F.when(r > 0, r), F.when(r <= 0, -r)
    g = t.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(r).alias("mean_return"),
        F.sum(_log(value)).alias("log_total"), F.stddev_samp(r).alias("sd"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_win"), F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
    )
    g = g.join(quantiles(t, keys, value, {"median_return": 0.5}), keys).join(max_drawdown(t, keys, value, order), keys)
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0.0))).otherwise(INF)
    return g.select(
        *keys, "n_trades", "win_rate", "mean_return", "median_return", F.expm1("log_total").alias("total_return"), F.col("log_total").alias("log_total_return"), F.coalesce("sd", F.lit(0.0)).alias("volatility"),
        sharpe(F.col("mean_return"), F.col("sd"), F.col("n_trades")).alias("sharpe"), over("gross_win", "gross_loss").alias("profit_factor"), "max_drawdown", "avg_win", "avg_loss", over("avg_win", "avg_loss").alias("payoff_ratio"),
    )


def per_strategy(value) -> Column:
    """A constant, or the constants of the strategies named and, under "", of all others."""
    if not isinstance(value, dict):
        return F.lit(value)
    out = F.lit(value[""])
    for name, v in value.items():
        out = F.when(F.col("strategy") == name, v).otherwise(out) if name else out
    return out


def deflated_sharpe(trades: DataFrame, keys: list[str], trials: int | dict[str, int], value: str = "net_return", trial_sd: float | None = None) -> DataFrame:
    """sharpe, its threshold for the best of so many trials, skew, kurtosis (normal: 3), z and the probability dsr.

    With under 3 trades, or where the variance of the Sharpe estimate is not positive, dsr is 0;
    for constant returns skew, z and dsr are null, which no gate takes for a pass.  trials is
    one number, or one for each strategy named ("" for all others).
    """
    r = F.col(value)
    n = per_strategy(trials)
    best = per_strategy({k: best_of(v) for k, v in trials.items()} if isinstance(trials, dict) else best_of(trials))
    g = trades.where(finite(r)).groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))
    few = F.col("n_obs") < 3
    g = g.withColumn("sharpe", F.when(few, 0.0).otherwise(sharpe(F.col("m"), F.col("sd"), F.col("n_obs"))))
    spread = F.lit(trial_sd) if trial_sd is not None else 1 / F.sqrt("n_obs")
    g = g.withColumn("sharpe_threshold", F.when(few, 0.0).otherwise(spread * best))
    vary = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = (F.col("sharpe") - F.col("sharpe_threshold")) * F.sqrt(F.col("n_obs") - 1) / F.sqrt(F.when(vary > 0, vary))
    g = g.withColumn("z", F.when(~few, z))
    dsr = F.when(few | (vary <= 0), 0.0).otherwise(cdf(F.col("z")))
    return g.select(*keys, "sharpe", "sharpe_threshold", dsr.alias("dsr"), "skew", "kurtosis", "z", "n_obs", n.alias("n_trials"))


def gates(s: Settings = DEFAULT) -> Column:
    """The reasons to reject, in order; an unknown probability is a reason too."""
    c = F.col
    dsr = F.coalesce(c("dsr"), F.lit(0.0))
    # The limits and the wording of the reasons.
    return F.array_compact(F.array(
        F.when(c("n_trades") < s.min_trades, F.concat(F.lit("only "), c("n_trades").cast("string"), F.lit(f" trades, need {s.min_trades}"))),
        F.when(c("mean_return") <= 0, F.lit("net mean return is not positive after costs")),
        F.when(dsr < 0.95, F.format_string("deflated Sharpe probability %.3f < 0.95", dsr)),
        F.when(c("total_folds").isNotNull() & (c("positive_folds") < c("total_folds") * 0.6), F.concat(F.lit("only "), c("positive_folds").cast("string"), F.lit("/"), c("total_folds").cast("string"), F.lit(" folds positive"))),
        F.when(c("cost_drag_ratio") > 0.8, F.concat(F.lit("costs consume "), F.when(c("cost_drag_ratio") < INF, F.round(c("cost_drag_ratio") * 100).cast("bigint").cast("string")).otherwise("inf"), F.lit("% of gross edge"))),
    ))


def breakeven_win_rate(payoff: Column) -> Column:
    return F.when(payoff <= 0, 1.0).otherwise(1 / (1 + payoff))


def kelly(p: Column, payoff: Column) -> Column:
    return F.when(payoff <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), p - (1 - p) / F.nullif(payoff, F.lit(0.0))))


def position_size(p: Column, payoff: Column, s: Settings = DEFAULT) -> tuple[Column, Column]:
    """(percent of capital: a share of Kelly up to the cap, whether to trade at all)."""
    size = F.least(F.lit(s.max_position_pct), kelly(p, payoff) * s.kelly_share * 100)
    return size, (p > breakeven_win_rate(payoff)) & (size > 0)
