"""The catalogue: one query for each operator or composition, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.kept import written
from ..functions.spans import asof
from ..functions.windows import series
from ..operators import evaluate, evolution, features, folds, forecasts, market, metalabel, overfitting, signals, statistics, store, trades
from ..sources import eventlog, tables
from . import fixtures as fx
from . import research

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BENCHMARK, TRIALS = "R", 20
BOUNDARY = "1998-06-01"
ALL = {"momentum_6", "momentum_24", "momentum_72", "momentum_168", "volatility_6", "volatility_24", "volatility_72", "volatility_168"}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded (and never -0) and whole numbers from windows as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.rint(c * 10.0**digits) / 10.0**digits + 0.0).alias(name) if kind == "double" else c.cast("bigint").alias(name) if name in ("idx", "entry_idx", "exit_idx", "bars_held", "pos") else c)
    return df.select(*out)


def stored(bars: DataFrame) -> DataFrame:
    """Bars that are made of ticks here, written as they would be at hand: a frame of features reads them several times."""
    return written(bars)


def frame(spark: SparkSession, sf: str, only: set[str] | None = None) -> DataFrame:
    return features.feature_frame(stored(tables.bars_daily(spark, sf)), tables.funding_weekly(spark, sf), BENCHMARK, only=only)


def _features(names: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(frame(spark, sf, set(names)).select("symbol", "timestamp", *names))

    return run


FEATURE_GROUPS = {
    "feat_returns": ["return_1", "log_return"],
    "feat_momentum": ["momentum_6", "momentum_24", "momentum_72", "momentum_168"],
    "feat_volatility": ["volatility_6", "volatility_24", "volatility_72", "volatility_168"],
    "feat_zscore": ["return_zscore"],
    "feat_atr": ["atr", "atr_pct"],
    "feat_volume_z": ["quote_volume_z"],
    "feat_taker": ["taker_buy_share", "taker_buy_share_z"],
    "feat_range_position": ["range_position"],
    "feat_funding": ["funding_rate", "funding_z", "funding_cum_7d"],
    "feat_beta_residual": ["benchmark_close", "benchmark_return", "beta_168", "residual_return"],
}
FRAME = [c for cs in FEATURE_GROUPS.values() for c in cs]
QUERIES |= {name: _features(cols) for name, cols in FEATURE_GROUPS.items()} | {"feature_frame": _features(FRAME)}


@query
def bars_daily(spark, sf):
    return rounded(tables.bars_daily(spark, sf), 4)


@query
def bars_15m(spark, sf):
    return rounded(tables.bars_15m(spark, sf), 4)


@query
def inventory(spark, sf):
    return tables.inventory(tables.bars_daily(spark, sf))


@query
def flow_coverage(spark, sf):
    return rounded(tables.flow_coverage(tables.book_spreads(spark, sf)))


@query
def inventory_summary(spark, sf):
    return rounded(tables.inventory_summary(tables.bars_daily(spark, sf), tables.book_spreads(spark, sf)))


@query
def universe_screen(spark, sf):
    t = spark.createDataFrame(fx.TICKER, "symbol string, lastPrice string, priceChangePercent string, quoteVolume string, count int")
    return market.universe(t, tables.bars_daily(spark, sf), 1_000_000.0)


@query
def asof_funding(spark, sf):
    b, d = tables.bars_15m(spark, sf), tables.bars_daily(spark, sf).where(F.col("symbol") == BENCHMARK)
    daily = d.select("timestamp", F.col("close").alias("daily_close")).join(b.select("symbol").distinct(), how="cross")  # one series for each symbol
    return rounded(asof(b, daily, ["symbol"], ["daily_close"]).select("symbol", "timestamp", "close", "daily_close"))


@query
def feature_frame_15m(spark, sf):
    f = features.feature_frame(stored(tables.bars_15m(spark, sf)), only={"momentum_24", "volatility_24", "range_position", "atr_pct"})
    return rounded(f.select("symbol", "timestamp", "momentum_24", "volatility_24", "range_position", "atr_pct"))


@query
def regime_label(spark, sf):
    f = frame(spark, sf, {"volatility_168", "momentum_168"})
    return features.regime(f.select("symbol", "timestamp", "idx", "volatility_168", "momentum_168")).select("symbol", "timestamp", "regime")


def _signal(strategies: list[signals.Strategy]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(trades.signals(frame(spark, sf), strategies))

    return run


def _sides(rule: signals.Rule):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = frame(spark, sf)
        return f.select("symbol", "timestamp", signals.compiled(rule).side(f).cast("int").alias("side"))

    return run


def _scaled(rule: signals.Rule) -> signals.Rule:
    """The rule with thresholds that this data reaches."""
    values = fx.SCALED[rule.name]
    return replace(rule, name=f"{rule.name}_scaled", conditions=tuple(replace(c, value=v) for c, v in zip(rule.conditions, values, strict=True)))


RULES = {f"rule_{r.name}": r for r in (*signals.SEEDS, signals.SMOKE, *[_scaled(r) for r in signals.SEEDS if r.name in fx.SCALED])}
QUERIES |= {name: _sides(r) for name, r in RULES.items()}
QUERIES |= {"null_always_long": _signal([signals.ALWAYS_LONG]), "null_alternating": _signal([signals.ALTERNATING]), "null_random_hash": _signal([signals.random_signal(1000)]), "lookahead_control": _signal([signals.LOOKAHEAD])}

LONG = signals.Strategy("every_long", lambda df: F.lit(1), 24, 2.0, 1.0)
SHORT = signals.Strategy("every_short", lambda df: F.lit(-1), 12, 1.5, 1.0)
BATCH = [*[signals.compiled(r) for r in RULES.values()], *signals.nulls(3), signals.LOOKAHEAD]
NEEDS = {"volatility_24", "volatility_168", "momentum_24", "momentum_168", "return_zscore", "quote_volume_z", "range_position", "taker_buy_share_z", "funding_z", "beta_168", "residual_return"}


def events(spark: SparkSession, sf: str, strategies: list[signals.Strategy] = BATCH, costs: bool = True) -> DataFrame:
    f = frame(spark, sf, NEEDS)
    return trades.trades(f, strategies, tables.funding_weekly(spark, sf) if costs else None, tables.book_spreads(spark, sf) if costs else None)


LABELS = ["strategy", "symbol", "entry_idx", "exit_idx", "entry_time", "exit_time", "side", "entry_price", "exit_price", "atr", "barrier", "bars_held", "gross_return", "label"]


@query
def triple_barrier_long(spark, sf):
    return rounded(events(spark, sf, [LONG]).select(*LABELS))


@query
def triple_barrier_short(spark, sf):
    return rounded(events(spark, sf, [SHORT]).select(*LABELS))


@query
def net_events(spark, sf):
    return rounded(events(spark, sf))


@query
def segments(spark, sf):
    f, out = frame(spark, sf, NEEDS), None
    for kind in ("research", "holdout", "all"):
        t = trades.trades(trades.segment(f, kind, F.lit(BOUNDARY).cast("timestamp_ntz"), since=F.lit("1993-01-01").cast("timestamp_ntz")), [signals.ALTERNATING])
        t = t.groupBy("symbol").agg(F.count("*").alias("n"), F.min("entry_time").alias("first"), F.max("exit_time").alias("last"), F.avg("gross_return").alias("mean_gross")).withColumn("segment", F.lit(kind))
        out = t if out is None else out.unionByName(t)
    return rounded(out)


@query
def funding_paid(spark, sf):
    b = tables.bars_daily(spark, sf)
    spans = b.select("symbol", "timestamp", F.lead("timestamp", 24).over(series(["symbol"])).alias("until")).where("until is not null")
    out = trades.funding_paid(spans.withColumn("id", F.struct("symbol", "timestamp")), tables.funding_weekly(spark, sf), "timestamp", "until", ["id"])
    return rounded(out.select("id.symbol", "id.timestamp", "paid"))


@query
def cost_breakdown(spark, sf):
    b, sp = tables.bars_daily(spark, sf), trades.spreads(tables.book_spreads(spark, sf))
    c = trades.adv(b).join(sp, "symbol").withColumn("impact_bps", 2 * trades.impact_bps(F.lit(1000.0), F.col("adv")))
    return rounded(c.select("symbol", "adv", F.lit(10.0).alias("fees_bps"), (F.col("spread_bps") * 1.5).alias("spread_cost_bps"), "impact_bps", trades.round_trip_cost(F.col("spread_bps"), F.col("impact_bps") / 2, F.lit(0.0)).alias("total_bps"), "source"), 4)


def _stats(t: DataFrame, keys: list[str]) -> DataFrame:
    """The statistics with the total return as a logarithm: it compounds beyond any fixed number of decimals."""
    return rounded(statistics.trade_statistics(t, keys).drop("total_return"), 5)


@query
def trade_stats(spark, sf):
    return _stats(events(spark, sf), ["strategy"])


@query
def trade_stats_by_regime(spark, sf):
    return _stats(events(spark, sf), ["strategy", "regime"])


@query
def drawdown_curve(spark, sf):
    return rounded(statistics.drawdown(events(spark, sf, [signals.ALTERNATING]), ["strategy"]).select("strategy", "symbol", "entry_time", "log_equity", "drawdown"), 5)


@query
def cv_folds(spark, sf):
    return rounded(folds.walk_forward(events(spark, sf), ["strategy"]))


@query
def fold_consistency(spark, sf):
    return rounded(folds.consistency(folds.walk_forward(events(spark, sf), ["strategy"]), ["strategy"]))


@query
def sharpe_moments(spark, sf):
    return rounded(statistics.deflated_sharpe(events(spark, sf), ["strategy"], TRIALS).select("strategy", "sharpe", "skew", "kurtosis", "n_obs"))


@query
def dsr_z(spark, sf):
    return rounded(statistics.deflated_sharpe(events(spark, sf), ["strategy"], TRIALS).select("strategy", "sharpe_threshold", "z"), 5)


@query
def dsr(spark, sf):
    return rounded(statistics.deflated_sharpe(events(spark, sf), ["strategy"], TRIALS).select("strategy", "dsr"), 5)


CARD = ["strategy", "n_trades", "mean_return", "sharpe", "dsr", "mean_cost_bps", "cost_drag_ratio", "positive_folds", "total_folds", "passed", "verdict"]


@query
def scorecard_batch(spark, sf):
    return rounded(evaluate.scorecards(events(spark, sf), TRIALS).select(*CARD), 5)


@query
def verdict_gates(spark, sf):
    return evaluate.scorecards(events(spark, sf), TRIALS).select("strategy", "passed", F.array_join("rejection_reasons", "; ").alias("reasons"))


@query
def strategy_fitness(spark, sf):
    return rounded(evaluate.fitness(evaluate.scorecards(events(spark, sf), TRIALS)).select("strategy", "fitness"), 5)


@query
def scorecard_nested(spark, sf):
    c = evaluate.nested(events(spark, sf), TRIALS).select("strategy", "scorecard.*")
    c = c.select("strategy", "verdict", "overall.n_trades", "overall.sharpe", "deflated.dsr", F.size("folds").cast("bigint").alias("n_folds"), F.aggregate("folds", F.lit(0).cast("bigint"), lambda a, f: a + f["n_trades"]).alias("fold_trades"), F.explode("by_regime").alias("regime", "r"))
    return rounded(c.select("strategy", "verdict", "n_trades", "sharpe", "dsr", "n_folds", "fold_trades", "regime", F.col("r.n_trades").alias("regime_trades"), F.col("r.mean_return").alias("regime_return"), F.col("r.max_drawdown").alias("regime_drawdown")), 5)


@query
def daily_returns_matrix(spark, sf):
    return rounded(overfitting.daily_returns(events(spark, sf, signals.nulls(3))).select("strategy", "day", "r"))


@query
def pbo_cscv(spark, sf):
    return rounded(overfitting.overfitting(overfitting.daily_returns(events(spark, sf, [LONG, SHORT, signals.Strategy("long_6", lambda df: F.lit(1), 6, 1.0, 1.0), signals.Strategy("short_48", lambda df: F.lit(-1), 48, 3.0, 2.0)]))))


@query
def null_suite(spark, sf):
    _, verdict = evaluate.null_suite(frame(spark, sf, NEEDS), tables.funding_weekly(spark, sf), tables.book_spreads(spark, sf), 5)
    return rounded(verdict)


@query
def ledger_summary(spark, sf):
    return store.ledger_summary(research.hypotheses(spark, sf), research.tests(spark, sf))


@query
def hypothesis_status(spark, sf):
    return store.hypotheses_now(research.hypotheses(spark, sf), research.tests(spark, sf)).select("id", "title", "status")


@query
def hypothesis_search(spark, sf):
    a = [store.search(research.hypotheses(spark, sf), k).select("id", "title").withColumn("keyword", F.lit(k)) for k in fx.KEYWORDS]
    return reduce(DataFrame.unionByName, a)


@query
def failure_log(spark, sf):
    return store.failure_log(research.hypotheses(spark, sf), research.tests(spark, sf))


@query
def holdout_budget(spark, sf):
    return store.holdout_budget(research.holdout(spark, sf))


@query
def archive_latest(spark, sf):
    return store.archive_latest(research.strategies(spark, sf)).select("id", "name", "generation", "niche", "fitness", "passed", "status")


@query
def elites_per_niche(spark, sf):
    return store.elites(research.strategies(spark, sf), 2).select("niche", "name", "fitness", F.col("rank").cast("bigint").alias("rank"))


@query
def archive_summary(spark, sf):
    return store.archive_summary(research.strategies(spark, sf))


@query
def niche_attribution(spark, sf):
    return rounded(store.niche_attribution(research.strategies(spark, sf)))


@query
def niche_of(spark, sf):
    return store.niche(research.strategies(spark, sf).select("id", "genome")).select("id", "niche")


def made_forecasts(spark, sf) -> DataFrame:
    """Forecasts on every third daily bar; agent, direction and probability follow from the position."""
    b = features.indexed(tables.bars_daily(spark, sf), ["symbol"]).where("idx % 3 = 0 and idx > 100")
    p = (F.col("idx") * 7919 % 97 + 1) / 98.0
    long = F.col("idx") % 2 == 0
    sign = F.when(long, 1.0).otherwise(-1.0)
    sid = F.when(F.col("symbol") == "A", 0).when(F.col("symbol") == "N", 1).otherwise(2)
    return b.select(
        (sid * 100_000 + F.col("idx")).cast("bigint").alias("id"), F.col("timestamp").alias("created_at"), F.concat(F.lit("agent_"), (F.col("idx") % 5).cast("string")).alias("agent_role"), "symbol", F.when(long, "long").otherwise("short").alias("direction"), p.alias("probability"),
        (F.col("idx") % 4 * 48 + 24).cast("int").alias("horizon_hours"), F.col("close").alias("entry_price"), (F.col("close") + sign * 0.8).alias("target_price"), (F.col("close") - sign * 0.6).alias("invalidation"), F.when(F.col("idx") % 7 < 3, "calm").otherwise("wild").alias("regime"),
    )


NOW = "1998-06-01"


def resolved_forecasts(spark, sf) -> DataFrame:
    f = made_forecasts(spark, sf)
    return f.join(forecasts.resolve(f, tables.bars_daily(spark, sf), F.lit(NOW).cast("timestamp_ntz")), "id", "left")


@query
def forecast_resolution(spark, sf):
    return rounded(forecasts.resolve(made_forecasts(spark, sf), tables.bars_daily(spark, sf), F.lit(NOW).cast("timestamp_ntz")))


SCORE = ["n", "base_rate", "mean_probability", "brier", "brier_base_rate", "overconfidence", "skill_score", "log_loss", "status"]


@query
def agent_scores(spark, sf):
    return rounded(forecasts.agent_scores(resolved_forecasts(spark, sf), ("agent_role", "regime")).select("agent_role", "regime", *SCORE))


@query
def leaderboard(spark, sf):
    return rounded(forecasts.agent_scores(resolved_forecasts(spark, sf)).select("agent_role", *SCORE).orderBy(F.desc("skill_score")))


@query
def reliability_curve(spark, sf):
    return rounded(forecasts.reliability(resolved_forecasts(spark, sf)).withColumn("bucket", F.col("bucket").cast("bigint")))


@query
def forecast_summary(spark, sf):
    return store.forecast_summary(resolved_forecasts(spark, sf))


@query
def forecasts_open(spark, sf):
    f = made_forecasts(spark, sf)
    done = forecasts.resolve(f, tables.bars_daily(spark, sf), F.lit(NOW).cast("timestamp_ntz")).select(F.col("id").alias("forecast_id"))
    return store.open_forecasts(f, done).select("id", "symbol", "horizon_hours")


@query
def research_state(spark, sf):
    h, t, a, x = research.hypotheses(spark, sf), research.tests(spark, sf), research.strategies(spark, sf), research.holdout(spark, sf)
    r = store.research_state(h, t, a, resolved_forecasts(spark, sf), x)
    return r.select("ledger.total_hypotheses", "ledger.promoted", "ledger.total_tests", "archive.total", "archive.active", "archive.niches_occupied", F.col("forecasts.total").alias("forecasts"), "forecasts.open", F.col("holdout.uses").alias("holdout_uses"))


@query
def holdout_history(spark, sf):
    return store.holdout_history(research.holdout(spark, sf))


@query
def monitor(spark, sf):
    a = spark.createDataFrame([(n, at, "active", RULES[f"rule_{n}"].genome(), f'{{"overall":{{"mean_return":{m},"volatility":{v}}}}}') for n, at, m, v in fx.WATCHED], "name string, created_at string, status string, genome string, scorecard string")
    return rounded(evolution.monitored(frame(spark, sf, NEEDS), a), 5)


@query
def calibration_shrink(spark, sf):
    return rounded(made_forecasts(spark, sf).select("id", forecasts.shrunk(F.col("probability")).alias("calibrated")))


@query
def calibration_isotonic(spark, sf):
    r = resolved_forecasts(spark, sf)
    return rounded(forecasts.calibrated(made_forecasts(spark, sf), r).select("id", "agent_role", "probability", "calibrated"))


@query
def price_stats(spark, sf):
    return rounded(market.price_stats(tables.bars_daily(spark, sf)), 5)


@query
def funding_profile(spark, sf):
    return rounded(market.funding_profile(tables.funding_weekly(spark, sf)), 5)


@query
def positioning_summary(spark, sf):
    return rounded(market.positioning(tables.bars_15m(spark, sf), "quote_volume"), 5)


@query
def order_book_walk(spark, sf):
    return rounded(market.order_book(research.books(spark, sf), 1000.0))


@query
def symbol_profile(spark, sf):
    return rounded(market.symbol_profile(tables.bars_daily(spark, sf), tables.book_spreads(spark, sf), BENCHMARK), 5)


@query
def correlation_matrix(spark, sf):
    return rounded(market.correlations(tables.bars_15m(spark, sf), 720, 50))


@query
def correlated_pairs(spark, sf):
    return rounded(market.correlation_report(market.correlations(tables.bars_daily(spark, sf)), BENCHMARK))


def _costs(spark, sf):
    return market.symbol_profile(tables.bars_daily(spark, sf), tables.book_spreads(spark, sf), BENCHMARK).select("symbol", "round_trip_bps")


@query
def trade_ev(spark, sf):
    ideas = spark.createDataFrame(fx.IDEAS, "symbol string, direction string, entry double, stop double, target double, win_probability double")
    return rounded(market.trade_ev(ideas, _costs(spark, sf)), 5)


@query
def position_size(spark, sf):
    """What the record of each month and symbol would have sized."""
    d = market.win_profile(tables.bars_daily(spark, sf).withColumn("month", F.date_trunc("month", "timestamp").cast("timestamp_ntz")), ("symbol", "month"))
    size, ok = statistics.position_size(F.col("p"), F.col("payoff"))
    return rounded(d.select("symbol", "month", "p", "payoff", statistics.breakeven_win_rate(F.col("payoff")).alias("breakeven"), statistics.kelly(F.col("p"), F.col("payoff")).alias("kelly"), size.alias("position_pct"), ok.alias("tradeable")))


@query
def exposure_caps(spark, sf):
    bars = tables.bars_15m(spark, sf)
    ideas = market.win_profile(bars).select("symbol", statistics.position_size(F.col("p"), F.col("payoff"))[0].alias("position_pct"))
    return rounded(market.exposure(ideas, market.correlations(bars, 720, 50), replace(DEFAULT, cluster_correlation=0.0)))


@query
def decay_zscore(spark, sf):
    f = frame(spark, sf, NEEDS)
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    a = statistics.trade_statistics(trades.trades(trades.segment(f, until=cut), BATCH), ["strategy"])
    b = statistics.trade_statistics(trades.trades(trades.segment(f, since=cut), BATCH), ["strategy"])
    return rounded(evaluate.decay(b, a), 5)


def _meta(spark, sf) -> DataFrame:
    f = frame(spark, sf, NEEDS | set(metalabel.CONTEXT))
    return metalabel.training_set(trades.trades(f, [signals.ALTERNATING], tables.funding_weekly(spark, sf), tables.book_spreads(spark, sf)), f)


@query
def meta_training_set(spark, sf):
    return rounded(_meta(spark, sf).select("symbol", "entry_time", "side", *metalabel.CONTEXT, "meta_label"))


@query
def meta_model_cv(spark, sf):
    return rounded(metalabel.cross_validated(_meta(spark, sf)))


@query
def meta_importances(spark, sf):
    return rounded(metalabel.importances(metalabel.trained(_meta(spark, sf))), 4)


@query
def positioning_measures(spark, sf):
    return rounded(market.positioning_report(tables.bars_15m(spark, sf), ["quote_volume", "volume", "taker_buy_quote"]), 5)


@query
def exact_auc(spark, sf):
    t = _meta(spark, sf).select("symbol", F.round("return_zscore", 1).alias("p"), "meta_label")
    return rounded(metalabel.auc(t, ["symbol"]).select("symbol", "auc", "n_test"))


@query
def lookahead_guard(spark, sf):
    f = frame(spark, sf, {"momentum_6", "momentum_24", "return_zscore", "quote_volume_z", "range_position"})
    return rounded(evaluate.lookahead_guard(f, ["momentum_6", "momentum_24", "return_zscore", "quote_volume_z", "range_position"]))


@query
def event_log_tail(spark, sf):
    return eventlog.read(research.log_lines(spark, sf), 100).select("index", "ts", "type")


@query
def event_log_page(spark, sf):
    return eventlog.page(research.log_lines(spark, sf), 100).select("index", "ts", "type")


@query
def event_count(spark, sf):
    return eventlog.event_count(research.log_lines(spark, sf))


@query
def feature_catalogue(spark, sf):
    """The features with their meanings, and on how many bars of how many symbols each is known."""
    f, names = frame(spark, sf, set(signals.FEATURES)), list(signals.FEATURES)
    known = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(signals.FEATURES[n]).alias("meaning"), (F.col(n).isNotNull() & ~F.isnan(n)).alias("known")) for n in names]))
    got = f.select("symbol", known.alias("x")).groupBy("x.feature", "x.meaning", "symbol").agg(F.count_if("x.known").alias("n"))
    return got.groupBy("feature", "meaning").agg(F.sum("n").alias("bars"), F.count_if(F.col("n") > 0).alias("symbols"))


@query
def return_profile(spark, sf):
    return rounded(market.return_profile(tables.bars_daily(spark, sf)))
