"""Scorecards of many strategies from one table of trades, null suite and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.kept import written
from .folds import consistency, walk_forward
from .overfitting import daily_returns, overfitting
from .signals import LOOKAHEAD, nulls
from .statistics import deflated_sharpe, gates, trade_statistics
from .trades import trades

KEY = ["strategy"]


def cost_drag(t: DataFrame, keys: list[str] = KEY) -> DataFrame:
    g = t.groupBy(*keys).agg(F.avg("cost_bps").alias("mean_cost_bps"), F.avg("gross_return").alias("gross_mean"))
    drag = F.when(F.col("gross_mean") == 0, float("inf")).otherwise(F.col("mean_cost_bps") / 10_000 / F.abs(F.nullif("gross_mean", F.lit(0.0))))
    return g.select(*keys, "mean_cost_bps", drag.alias("cost_drag_ratio"))


def scorecards(t: DataFrame, trials: int | dict[str, int] = 1, s: Settings = DEFAULT) -> DataFrame:
    """One row for each strategy that trades: statistics, deflation, folds, costs, verdict and its reasons.

    The trades are read several times, so they are written first.  trials: see deflated_sharpe().
    """
    return _cards(written(t), trials, s)


def _cards(t: DataFrame, trials: int | dict[str, int], s: Settings) -> DataFrame:
    base = trade_statistics(t, KEY)
    deflated = deflated_sharpe(t, KEY, trials).select("strategy", "sharpe_threshold", "dsr", "skew", "kurtosis", "z", "n_trials")
    out = base.join(deflated, "strategy").join(cost_drag(t), "strategy").join(consistency(walk_forward(t, KEY, s.splits, s.embargo), KEY), "strategy", "left")
    out = out.withColumn("rejection_reasons", gates(s))
    passed = F.size("rejection_reasons") == 0
    return out.withColumns({"passed": passed, "verdict": F.when(passed, "promote").otherwise("reject"), "harness_version": F.lit(s.version)})


def nested(t: DataFrame, trials: int = 1, s: Settings = DEFAULT) -> DataFrame:
    """(strategy, scorecard): the scorecard as a struct with folds and a map by regime, ready for to_json()."""
    t = written(t)
    flat = _cards(t, trials, s)
    stats = [c for c in trade_statistics(t, KEY).columns if c != "strategy"]
    regimes = trade_statistics(t, ["strategy", "regime"]).groupBy("strategy").agg(F.map_from_entries(F.collect_list(F.struct("regime", F.struct(*stats)))).alias("by_regime"))
    folds = walk_forward(t, KEY, s.splits, s.embargo)
    folds = folds.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct(*[c for c in folds.columns if c != "strategy"]))).alias("folds"))
    out = flat.join(regimes, "strategy").join(folds, "strategy", "left")
    deflated = F.struct("sharpe", "sharpe_threshold", "dsr", "skew", "kurtosis", "n_trials")
    steady = F.struct("mean_sharpe", "std_sharpe", "positive_folds", "total_folds")
    return out.select("strategy", F.struct(F.struct(*stats).alias("overall"), deflated.alias("deflated"), "folds", steady.alias("fold_consistency"), "by_regime", "mean_cost_bps", "cost_drag_ratio", "passed", "verdict", "rejection_reasons", "harness_version").alias("scorecard"))


def fitness(cards: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """cards with fitness: dsr * sharpe (above 0), discounted by the share of folds that lose; 0 for few trades."""
    share = F.coalesce(F.col("positive_folds") / F.nullif("total_folds", F.lit(0)), F.lit(0.0))
    value = F.coalesce("dsr", F.lit(0.0)) * F.greatest("sharpe", F.lit(0.0)) * (0.5 + 0.5 * share)
    return cards.withColumn("fitness", F.when(F.col("n_trades") < s.min_trades, 0.0).otherwise(value))


def null_suite(frame: DataFrame, funding: DataFrame | None = None, book: DataFrame | None = None, n_random: int = 5, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(cards of nulls and control, one row with the verdict on the evaluation itself): one plan for all strategies.

    The nulls count as n_random trials, the control as one.
    """
    t = written(trades(frame, [*nulls(n_random), LOOKAHEAD], funding, book, s))
    control = F.col("strategy") == LOOKAHEAD.name
    cards = written(_cards(t, {"": n_random, LOOKAHEAD.name: 1}, s))
    pbo = overfitting(daily_returns(t.where(F.col("strategy").startswith("null_random"))))
    verdict = cards.agg(F.count(F.when(~control, 1)).alias("nulls_evaluated"), F.count(F.when(~control & F.col("passed"), 1)).alias("nulls_passed"), F.coalesce(F.max(F.when(control, F.col("passed"))), F.lit(False)).alias("control_passed"))
    verdict = verdict.withColumn("trustworthy", (F.col("nulls_passed") == 0) & F.col("control_passed"))
    return cards, verdict.join(pbo.select("pbo"), how="cross")


def decay(live: DataFrame, backtest: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Live trades of strategies against their backtests: z of the mean, and what to do.

    live and backtest have strategy, n_trades, mean_return, volatility.  Under 5 live trades
    are too few; a z below the limit, or a loss where the backtest gained, retires.
    """
    b = backtest.select("strategy", F.col("mean_return").alias("expected"), F.col("volatility").alias("expected_vol"))
    d = live.select("strategy", "n_trades", "mean_return").join(b, "strategy")
    z = (F.col("mean_return") - F.col("expected")) / F.nullif(F.col("expected_vol") / F.sqrt("n_trades"), F.lit(0.0))
    few = F.col("n_trades") < 5
    bad = (F.coalesce(z, F.lit(0.0)) < s.decay_z) | ((F.col("mean_return") <= 0) & (F.col("expected") > 0))
    return d.select("strategy", "n_trades", "mean_return", "expected", F.when(~few, z).alias("decay_z"), F.when(few, "insufficient").when(bad, "retire").otherwise("healthy").alias("status"))


def lookahead_guard(frame: DataFrame, names: list[str], limit: float = 0.2) -> DataFrame:
    """Correlation of each (lagged) feature with the bar's next return; one that reaches the limit leaks."""
    from ..functions.windows import series

    ahead = F.lead("close").over(series(["symbol"])) / F.col("close") - 1
    got = frame.withColumn("ahead", ahead).agg(*[F.corr(n, "ahead").alias(n) for n in names])
    out = got.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))).alias("feature", "correlation"))
    return out.withColumn("ok", F.coalesce(F.abs("correlation") < limit, F.lit(True)))
