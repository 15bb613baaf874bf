"""Market summaries: prices, funding, positioning, order books, correlations, single trades."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.windows import change, series
from .features import feature_frame
from .statistics import breakeven_win_rate, kelly, position_size
from .trades import adv, impact_bps, round_trip_cost, spreads


def latest_first():
    return W.partitionBy("symbol").orderBy(F.desc("timestamp"))


def recent(df: DataFrame, n: int) -> DataFrame:
    """The last n rows of each symbol, with back, the place from the end (1 is the last)."""
    return df.withColumn("back", F.row_number().over(latest_first())).where(F.col("back") <= n)


def _at(k: int, c: str = "close"):
    return F.max(F.when(F.col("back") == k, F.col(c)))


def price_stats(bars: DataFrame, lookback: int = 720) -> DataFrame:
    counts = bars.groupBy("symbol").agg(F.count("*").alias("bars_available"), F.min("timestamp").alias("since"))
    r = recent(bars, lookback).withColumn("ret", change(series(["symbol"]), F.col("close")))
    g = r.groupBy("symbol").agg(_at(1).alias("last_price"), *[(_at(k + 1)).alias(f"c{k}") for k in (6, 24, 72, 168)], F.stddev_samp("ret").alias("volatility"), F.max("high").alias("high"), F.min("low").alias("low"), F.avg("quote_volume").alias("mean_quote_volume"), _at(1, "quote_volume").alias("last_volume"))
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return g.join(counts, "symbol").select(
        "symbol", "bars_available", F.date_format("since", "yyyy-MM-dd").alias("history_since"), "last_price", *[(F.col("last_price") / F.col(f"c{k}") - 1).alias(f"return_{k}b") for k in (6, 24, 72, 168)], "volatility",
        "high", "low", over(F.col("last_price") - F.col("low"), F.col("high") - F.col("low")).alias("position_in_range"), "mean_quote_volume", over(F.col("last_volume"), F.col("mean_quote_volume")).alias("volume_vs_mean"),
    )


def funding_profile(funding: DataFrame, recent_rows: int = 21) -> DataFrame:
    """The last rate, its percentile and z, and what it costs a year at three payments a day."""
    f = funding.withColumn("back", F.row_number().over(latest_first()))
    last = f.where("back = 1").select("symbol", F.col("funding_rate").alias("current"))
    r, new = F.col("funding_rate"), F.when(F.col("back") <= recent_rows, F.col("funding_rate"))
    g = f.join(last, "symbol").groupBy("symbol", "current").agg(F.count("*").alias("n"), (F.avg(F.when(r < F.col("current"), 1.0).otherwise(0.0)) * 100).alias("percentile"), F.avg(new).alias("mean_recent"), F.sum(new).alias("sum_recent"), F.stddev_samp(new).alias("sd_recent"), F.avg(r).alias("mean_all"), F.stddev_samp(r).alias("sd_all"))
    return g.select("symbol", "n", "current", (F.col("current") * 3 * 365 * 100).alias("annualised_pct"), "percentile", "mean_recent", "sum_recent", "mean_all", "sd_all", ((F.col("current") - F.col("mean_recent")) / F.nullif("sd_recent", F.lit(0.0))).alias("z_recent"))


def positioning(values: DataFrame, column: str, rows: int = 168) -> DataFrame:
    """Of the last rows: the current value, mean, change over 24 rows in percent, and z."""
    r = recent(values, rows)
    g = r.groupBy("symbol").agg(_at(1, column).alias("current"), F.avg(column).alias("mean"), _at(25, column).alias("before"), F.stddev_samp(column).alias("sd"), F.count("*").alias("n"))
    return g.select("symbol", "n", "current", "mean", ((F.col("current") / F.nullif("before", F.lit(0.0)) - 1) * 100).alias("change_24_pct"), ((F.col("current") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("zscore"))


def positioning_report(values: DataFrame, columns: list[str], rows: int = 168) -> DataFrame:
    """(symbol, measure, n, current, mean, change_24_pct, zscore): positioning() of several measures side by side; one without any value has no row."""
    long = values.select("symbol", "timestamp", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("symbol", "timestamp", "x.*")
    long = long.where("value is not null").withColumn("symbol", F.struct("symbol", "measure"))
    return positioning(long, "value", rows).select("symbol.symbol", "symbol.measure", "n", "current", "mean", "change_24_pct", "zscore")


def order_book(books: DataFrame, notional: float = 1000.0) -> DataFrame:
    """books (symbol, bids, asks: arrays of price and qty, best first): spread, depth, and the fill of a buy of that size.

    The average fill weighs prices by dollars; fillable means 99 percent of the size or more.
    """
    usd = lambda side: F.aggregate(side, F.lit(0.0), lambda a, x: a + x["price"].cast("double") * x["qty"].cast("double"))
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def take(a, x):
        t = F.greatest(F.lit(0.0), F.least(x["price"].cast("double") * x["qty"].cast("double"), notional - a["filled"]))
        return F.struct((a["filled"] + t).alias("filled"), (a["cost"] + t * x["price"].cast("double")).alias("cost"))

    b = books.where((F.size("bids") > 0) & (F.size("asks") > 0)).select("symbol", F.col("bids")[0]["price"].cast("double").alias("bid"), F.col("asks")[0]["price"].cast("double").alias("ask"), usd(F.col("bids")).alias("bid_usd"), usd(F.col("asks")).alias("ask_usd"), F.aggregate("asks", start, take).alias("f"))
    mid = (F.col("bid") + F.col("ask")) / 2
    fill = F.col("f.cost") / F.nullif("f.filled", F.lit(0.0))
    return b.select("symbol", mid.alias("mid"), ((F.col("ask") - F.col("bid")) / mid * 10_000).alias("spread_bps"), "bid_usd", "ask_usd", ((F.col("bid_usd") - F.col("ask_usd")) / F.nullif(F.col("bid_usd") + F.col("ask_usd"), F.lit(0.0))).alias("imbalance"), (F.col("f.filled") >= notional * 0.99).alias("fillable"), ((fill - F.col("ask")) / mid * 10_000).alias("slippage_bps"))


def universe(ticker: DataFrame, bars: DataFrame, min_volume: float) -> DataFrame:
    """The day's ticker with the history at hand, the most traded first."""
    local = bars.groupBy("symbol").agg(F.count("*").alias("local_bars"), F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("history_since"))
    t = ticker.select("symbol", F.col("lastPrice").cast("double").alias("last_price"), F.col("priceChangePercent").cast("double").alias("change_24h_pct"), F.col("quoteVolume").cast("double").alias("quote_volume_24h"), F.col("count").cast("bigint").alias("trades_24h"))
    t = t.join(local, "symbol", "left").withColumn("local_bars", F.coalesce("local_bars", F.lit(0).cast("bigint")))
    return t.withColumn("liquid", F.col("quote_volume_24h") >= min_volume).orderBy(F.desc("quote_volume_24h"), "symbol")


def aligned_returns(bars: DataFrame, lookback: int = 720, least: int = 50) -> DataFrame:
    """(symbol, timestamp, r): the last returns of each symbol that has more than `least`, at times that all of them have."""
    r = bars.withColumn("r", change(series(["symbol"]), F.col("close"))).where("r is not null")
    r = recent(r, lookback).withColumn("have", F.count("*").over(W.partitionBy("symbol"))).where(F.col("have") > least)
    n = r.agg(F.count_distinct("symbol").alias("all"))
    full = r.groupBy("timestamp").agg(F.count("*").alias("k")).join(n, F.col("k") == F.col("all")).select("timestamp")
    return r.join(full, "timestamp", "left_semi").select("symbol", "timestamp", "r")


#: Symbols in a tile of the correlation matrix.
TILE = 256


def correlations(bars: DataFrame, lookback: int = 720, least: int = 50) -> DataFrame:
    """(a, b, correlation, n) of each pair of symbols, a before b; null where one of them never moves.

    The returns of a symbol are one vector of at most `lookback` numbers, centred and of length
    one.  Symbols are dealt into tiles; each pair of tiles is one product of two matrices.  So what
    travels is each vector once a tile, and not a row for each pair and time.
    """
    x = aligned_returns(bars, lookback, least)
    vectors = x.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "r"))), lambda t: t["r"]).alias("v"))
    tiles = F.broadcast(x.agg(F.ceil(F.count_distinct("symbol") / TILE).cast("int").alias("tiles")))  # one row
    dealt = vectors.crossJoin(tiles).withColumn("tile", F.pmod(F.hash("symbol"), "tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    sent = dealt.select("symbol", "v", "tile", other).select("symbol", "v", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))

    def product(t: pa.Table) -> pa.Table:
        names, tile = np.array(t.column("symbol").to_pylist(), object), t.column("tile").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        m = np.array(t.column("v").to_pylist(), float)
        m = m - m.mean(axis=1, keepdims=True)
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, size, out=np.full_like(m, np.nan), where=size > 1e-12)
        rows, cols = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        c = np.clip(m[rows] @ m[cols].T, -1, 1)
        x, y = names[rows][:, None], names[cols][None, :]
        i, j = np.nonzero(x < y) if lo == hi else np.indices(c.shape).reshape(2, -1)
        a, b = np.minimum(x, y)[i, j], np.maximum(x, y)[i, j]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "correlation": pa.array(c[i, j], from_pandas=True), "n": pa.array(np.full(len(i), m.shape[1]), pa.int64())})

    return sent.groupBy("lo", "hi").applyInArrow(product, "a string, b string, correlation double, n bigint")


def correlation_report(pairs: DataFrame, benchmark: str, s: Settings = DEFAULT) -> DataFrame:
    """pairs with mean (over all pairs), clustered (above the threshold) and whether the benchmark is one of them."""
    mean = pairs.agg(F.avg("correlation").alias("mean_correlation"))
    with_benchmark = (F.col("a") == benchmark) | (F.col("b") == benchmark)
    return pairs.join(mean, how="cross").withColumns({"clustered": F.col("correlation") > s.cluster_correlation, "with_benchmark": with_benchmark})


def symbol_profile(bars: DataFrame, book: DataFrame, benchmark: str, s: Settings = DEFAULT) -> DataFrame:
    """The last features of each symbol, its drawdown from the high, volume, cost and correlation to the benchmark."""
    f = feature_frame(bars, only={"volatility_168", "momentum_24", "momentum_168", "return_zscore", "atr_pct", "range_position"})
    last = recent(f, 1).select("symbol", "timestamp", "close", "momentum_24", "momentum_168", "volatility_168", "return_zscore", "atr_pct", "range_position")
    peak = F.max("close").over(series(["symbol"]).rowsBetween(W.unboundedPreceding, 0))
    dd = bars.withColumn("d", F.col("close") / peak - 1).groupBy("symbol").agg(F.min("d").alias("max_drawdown"), F.max_by("d", "timestamp").alias("drawdown"))
    cost = adv(bars, s).join(spreads(book, s), "symbol", "left").withColumn("spread_bps", F.coalesce("spread_bps", F.lit(s.fallback_spread_bps)))
    cost = cost.select("symbol", "adv", round_trip_cost(F.col("spread_bps"), impact_bps(F.lit(s.notional), F.col("adv"), s), F.lit(0.0), s).alias("round_trip_bps"))
    p = correlations(bars, s.adv_bars)
    other = p.where((F.col("a") == benchmark) | (F.col("b") == benchmark)).select(F.when(F.col("a") == benchmark, F.col("b")).otherwise(F.col("a")).alias("symbol"), F.col("correlation").alias("benchmark_correlation"))
    return last.join(dd, "symbol").join(cost, "symbol").join(other, "symbol", "left")


def trade_ev(ideas: DataFrame, costs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """ideas (symbol, direction, entry, stop, target, win_probability) with their arithmetic.

    costs has symbol, round_trip_bps.  error names what is wrong with an idea; its other
    columns are then null.
    """
    c = F.col
    sign = F.when(c("direction") == "long", 1.0).otherwise(-1.0)
    t = ideas.join(costs.select("symbol", "round_trip_bps"), "symbol", "left").withColumns({"risk": sign * (c("entry") - c("stop")), "reward": sign * (c("target") - c("entry"))})
    p = c("win_probability")
    # The wording of the errors.
    error = F.when(~c("direction").isin("long", "short"), "direction must be 'long' or 'short'").when(~((p > 0) & (p < 1)), "win_probability must be strictly between 0 and 1")
    error = error.when(c("risk") <= 0, F.concat(F.lit("stop is on the wrong side of entry for a "), c("direction"))).when(c("reward") <= 0, F.concat(F.lit("target is on the wrong side of entry for a "), c("direction")))
    t = t.withColumn("error", error).withColumns({k: F.when(c("error").isNull(), c(k)) for k in ("risk", "reward")})
    payoff = c("reward") / c("risk")
    gross = p * c("reward") / c("entry") - (1 - p) * c("risk") / c("entry")
    net = gross - F.coalesce("round_trip_bps", F.lit(s.cost_floor_bps)) / 10_000
    size, _ = position_size(p, payoff, s)
    return t.select(
        *ideas.columns, "error", (c("risk") / c("entry") * 100).alias("risk_pct"), (c("reward") / c("entry") * 100).alias("reward_pct"), payoff.alias("r_multiple"), F.when(payoff.isNotNull(), breakeven_win_rate(payoff)).alias("breakeven_win_rate"),
        (gross * 100).alias("gross_ev_pct"), (net * 100).alias("net_ev_pct"), F.when(payoff.isNotNull(), kelly(p, payoff) * 100).alias("full_kelly_pct"), F.when(payoff.isNotNull(), size).alias("position_pct"), ((net > 0) & (payoff >= s.min_r_multiple)).alias("tradeable"),
    )


def exposure(ideas: DataFrame, pairs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """ideas (symbol, position_pct) against the caps on total exposure and on what correlates with each."""
    both = pairs.where(F.col("correlation") > s.cluster_correlation).select("a", "b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(ideas.select(F.col("symbol").alias("a"), F.col("symbol").alias("b")).distinct())
    near = both.join(ideas.select(F.col("symbol").alias("b"), F.col("position_pct").alias("p")), "b").groupBy(F.col("a").alias("symbol")).agg(F.sum("p").alias("cluster_pct"))
    total = ideas.agg(F.sum("position_pct").alias("total_pct"))
    out = ideas.join(near, "symbol", "left").join(total, how="cross")
    return out.withColumns({"within_cluster_cap": F.col("cluster_pct") <= s.max_cluster_pct, "within_total_cap": F.col("total_pct") <= s.max_total_pct})


def return_profile(bars: DataFrame) -> DataFrame:
    """(symbol, mean_return, volatility, n) of each symbol's returns from bar to bar."""
    r = bars.withColumn("r", change(series(["symbol"]), F.col("close")))
    return r.groupBy("symbol").agg(F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("volatility"), F.count("r").alias("n"))


def win_profile(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys with p, the share of a symbol's returns from bar to bar that are gains, and payoff, the mean gain over the mean loss.

    keys are the symbol and columns of the bar; payoff is null without a gain or without a loss.
    """
    r = bars.withColumn("r", change(series(["symbol"]), F.col("close"))).where("r is not null")
    gain, loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") < 0, -F.col("r")))
    return r.groupBy(*keys).agg(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("p"), (gain / loss).alias("payoff"))
