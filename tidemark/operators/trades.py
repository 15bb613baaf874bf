"""Trades of many strategies in one plan: segment, signal, barriers, costs, regime.

A series is cut into blocks of bars, each with the bars before it that windows look at and
those behind it that the longest horizon reaches, so that blocks of one symbol are settled side
by side after one exchange.  Within a block all entries of all strategies find their first
touch together, by bisection in tables of minima and maxima: an entry costs the logarithm
of its horizon.  Only entries become rows again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Settings
from ..functions.kept import written
from ..functions.order import quantiles
from ..functions.paths import first_touch, regimes
from ..functions.spans import asof, running_sum
from ..sources.tables import BASE
from .features import BLOCK, HALO, in_blocks, indexed, true_average
from .signals import Strategy, StrategyError


def segment(frame: DataFrame, kind: str = "all", boundary=None, since=None, until=None) -> DataFrame:
    """The bars of a segment: research before the boundary, holdout from it on, or all; since <= t < until."""
    t = F.col("timestamp")
    if kind not in ("research", "holdout", "all"):
        raise ValueError(f"unknown segment: {kind}")
    if kind != "all" and boundary is None:
        raise ValueError(f"the {kind} segment needs a boundary")
    out = frame.where(t < F.lit(boundary)) if kind == "research" else frame.where(t >= F.lit(boundary)) if kind == "holdout" else frame
    out = out if since is None else out.where(t >= F.lit(since))
    return out if until is None else out.where(t < F.lit(until))


def _starts(strategies: list[Strategy]) -> list[str | None]:
    """The times from which on strategies count bars, each once; None first."""
    return sorted({x.since for x in strategies}, key=lambda t: (t is not None, t or ""))


def _since(frame: DataFrame, starts: list[str | None], keys: list[str], s: Settings) -> DataFrame:
    """(keys, bars_, adv_): for each start the bars of a series from there on, and the daily volume of its last ones."""
    last = F.col("idx") >= F.col("n") - s.adv_bars
    on = [F.lit(True) if t is None else F.col("timestamp") >= F.lit(t).cast("timestamp_ntz") for t in starts]
    return frame.groupBy(*keys).agg(F.array(*[F.count(F.when(c, 1)) for c in on]).alias("bars_"), F.array(*[F.avg(F.when(c & last, F.col("quote_volume"))) * s.bars_per_day for c in on]).alias("adv_"))


def adv(frame: DataFrame, s: Settings = DEFAULT, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, adv): mean quote volume of the last adv_bars bars, times the bars of a day."""
    last = frame if {"idx", "n"} <= set(frame.columns) else indexed(frame.select(*keys, "timestamp", "quote_volume"), list(keys))
    last = last.where(F.col("idx") >= F.col("n") - s.adv_bars)
    return last.groupBy(*keys).agg((F.avg("quote_volume") * s.bars_per_day).alias("adv"))


def impact_bps(notional: Column, adv_usd: Column, s: Settings = DEFAULT) -> Column:
    """Square-root impact; without volume or size, ten times the coefficient."""
    none = F.coalesce(adv_usd <= 0, F.lit(True)) | (notional <= 0)
    return F.when(none, s.impact_coefficient_bps * 10).otherwise(s.impact_coefficient_bps * F.sqrt(notional / F.nullif(adv_usd, F.lit(0.0))))


def spreads(book: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(symbol, spread_bps, source): the third quartile, or the fallback where the median is not above 0."""
    out = book.groupBy("symbol").agg(F.count("*").alias("n")).join(quantiles(book, ["symbol"], "spread_bps", {"q2": 0.5, "q3": 0.75}), "symbol", "left")
    good = F.coalesce((F.col("q2") > 0) & (F.col("q2") < float("inf")), F.lit(False))
    return out.select("symbol", F.when(good, F.greatest("q2", "q3")).otherwise(s.fallback_spread_bps).alias("spread_bps"), F.when(good, F.concat(F.lit("observed:"), F.col("n").cast("string"))).otherwise("fallback").alias("source"))


def round_trip_cost(spread: Column, impact: Column, funding: Column, s: Settings = DEFAULT) -> Column:
    """Fees both ways, the spread with its margin, impact both ways and funding; never below the floor."""
    return F.greatest(F.lit(s.cost_floor_bps), 2 * s.taker_fee_bps + spread * s.spread_multiplier + 2 * impact + funding)


def cumulative_funding(funding: DataFrame) -> DataFrame:
    return running_sum(funding, ["symbol"], "funding_rate", "funding_sum").select("symbol", "timestamp", "funding_sum")


def funding_paid(spans: DataFrame, funding: DataFrame, entry: str, exit: str, id: list[str]) -> DataFrame:
    """id and paid, the sum of funding in (entry, exit] of each span: two as-of lookups in running sums."""
    sums = cumulative_funding(funding)
    ends = spans.select(*id, "symbol", F.col(entry).alias("timestamp"), F.lit(-1.0).alias("sign")).unionByName(spans.select(*id, "symbol", F.col(exit).alias("timestamp"), F.lit(1.0).alias("sign")))
    times = spans.select(F.col(exit).alias("timestamp"))
    return asof(ends, sums, ["symbol"], ["funding_sum"], times=times.unionByName(spans.select(F.col(entry).alias("timestamp")))).groupBy(*id).agg(F.sum(F.col("sign") * F.coalesce("funding_sum", F.lit(0.0))).alias("paid"))


def signals(frame: DataFrame, strategies: list[Strategy], s: Settings = DEFAULT) -> DataFrame:
    """(strategy, symbol, idx, timestamp, side) where a strategy's side is not 0; sides are clipped to -1..1."""
    f = indexed(frame.drop("idx", "n"), ["symbol"]).where(F.col("n") >= s.min_segment_bars)
    f = f.withColumn("st", sides(f, strategies)).select("symbol", "idx", "timestamp", F.explode("st").alias("st"))
    return f.select(F.col("st.name").alias("strategy"), "symbol", "idx", "timestamp", F.col("st.side").alias("side"))


def sides(f: DataFrame, strategies: list[Strategy]) -> Column:
    """Structs (k, name, side) of the strategies that have a side on a bar."""
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))

    def side(x: Strategy) -> Column:
        try:
            out = F.coalesce(x.side(f).cast("double"), F.lit(0.0))
        except Exception as e:  # whatever a user's function raises
            raise StrategyError(f"{x.name}: {e}") from e
        return out if x.since is None else F.when(F.col("timestamp") >= F.lit(x.since).cast("timestamp_ntz"), out).otherwise(0.0)

    made = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x.name).alias("name"), clip(side(x)).alias("side")) for k, x in enumerate(strategies)]), lambda t: t["side"] != 0)
    try:
        f.select(made)
    except AnalysisException as e:
        for x in strategies:
            try:
                f.select(side(x))
            except AnalysisException as own:
                raise StrategyError(f"{x.name}: {own}") from own
        raise StrategyError(f"{', '.join(x.name for x in strategies)}: {e}") from e
    return made


def _positions(frame: DataFrame, keys: list[str]) -> DataFrame:
    """frame, a written table, with idx from 0 and n: by the positions that it has, if these are without gaps, else numbered anew."""
    if "idx" in frame.columns:
        ends = frame.groupBy(*keys).agg(F.min("idx").alias("lo_"), F.max("idx").alias("hi_"), F.count("*").alias("n"))
        if ends.where("hi_ - lo_ + 1 <> n").isEmpty():
            return frame.drop("n").join(ends.drop("hi_"), keys).withColumn("idx", F.col("idx") - F.col("lo_")).drop("lo_")
    return indexed(frame.drop("idx", "n"), keys)


_BAR = ["idx", "timestamp", "high", "low", "close", "funding_sum"]
_MADE = "k int, entry_idx int, exit_idx int, side double, entry_price double, exit_price double, atr double, barrier string, regime string, paid_before double, paid_after double"


def _settled(keys: list[str], strategies: list[Strategy], known: bool):
    """Of a block's bars: a row for each entry of each strategy; known: whether regimes are.

    For strategies that count bars from a time in the block on, average range and regime begin there; both
    forget what lies a halo behind them, so blocks further on need nothing of it.
    """
    starts = _starts(strategies)
    group = np.array([starts.index(x.since) for x in strategies])
    begin = [None if t is None else pd.Timestamp(t).tz_localize(None).to_datetime64() for t in starts]
    horizon = np.array([x.horizon for x in strategies])
    pt, sl = (np.array([float(getattr(x, c)) for x in strategies]) for c in ("pt_atr", "sl_atr"))

    def of(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        idx, high, low, close, paid, *context = (np.asarray(t.column(c).to_numpy(zero_copy_only=False), float) for c in ("idx", "high", "low", "close", "funding_sum", *(("volatility_168", "momentum_168") if known else ())))
        st = t.column("st").combine_chunks()
        at, flat = pc.list_parent_indices(st).to_numpy(), pc.list_flatten(st)
        k, side = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("k", "side"))
        times = t.column("timestamp").to_numpy()
        atr, label = np.full((len(starts), len(idx)), np.nan), np.full((len(starts), len(idx)), "unknown", object)
        for g, since in enumerate(begin):
            i = 0 if since is None else int(np.searchsorted(times, since))
            atr[g, i:] = true_average(high[i:], low[i:], close[i:], idx[i:] - (idx[i] if 0 < i < len(idx) else 0))
            if known:
                label[g, i:] = regimes(*(c[i:] for c in context))
        atr, label = atr[group[k], at], label[group[k], at]
        good = (atr > 0) & (close[at] > 0)
        at, k, side, unit, regime = at[good], k[good], side[good], atr[good], label[good]
        up, price = np.sign(side), close[at]
        target, stop = price + up * pt[k] * unit, price - up * sl[k] * unit
        long, end = up > 0, np.minimum(at + horizon[k], len(idx) - 1)
        hit = first_touch(high, low, at + 1, end, np.where(long, stop, target), np.where(long, target, stop))
        touched, out = hit <= end, np.minimum(hit, end)
        stopped = touched & np.where(long, low[out] <= stop, high[out] >= stop)
        barrier = np.where(stopped, "stop", np.where(touched, "target", "vertical"))
        made = [k, idx[at], idx[out], side, price, np.where(stopped, stop, np.where(touched, target, close[out])), unit, barrier, regime, paid[at], paid[out]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = [pa.array(x.astype(int) if kind == pa.int32() else x, kind) for x, kind in zip(made, kinds, strict=True)]
        time = t.column("timestamp")
        return pa.table([*[t.column(c).take(at) for c in keys], time.take(at), time.take(out), *columns], names=[*keys, "entry_time", "exit_time", *[x.split()[0] for x in _MADE.split(", ")]])

    return of


def trades(frame: DataFrame, strategies: list[Strategy], funding: DataFrame | None = None, book: DataFrame | None = None, s: Settings = DEFAULT, keys: tuple[str, ...] = ("symbol",), block: int = BLOCK) -> DataFrame:
    """One row for each bar and strategy with a side: barriers, costs, regime.

    frame is a (lagged) feature frame, already cut to its segment; ATR, regime and volume
    are taken within it.  Entry is the close; within a bar the stop is met before the target;
    fills are at the barrier; without either by the horizon, at that bar's close.  For a strategy
    with a time of its own (since), all of this holds for the bars from then on.
    keys tell series apart, if a symbol has several.  The frame is read several times (length of the
    series, volume, bars), so it is written first.
    """
    keys = list(keys)
    frame = _positions(written(frame), keys)
    known = {"volatility_168", "momentum_168"} <= set(frame.columns)
    f = frame.where(F.col("n") >= s.min_segment_bars)
    f = asof(f, cumulative_funding(funding), ["symbol"], ["funding_sum"], times=frame) if funding is not None else f.withColumn("funding_sum", F.lit(0.0))
    longest = max(x.horizon for x in strategies)
    f, bk = in_blocks(f, keys, max(block, -(-longest // HALO) * HALO), longest)
    own = F.when(F.col("part_") == 0, F.transform(sides(f, strategies), lambda x: F.struct(x["k"].alias("k"), x["side"].alias("side"))))
    f = f.withColumns({"st": own, "funding_sum": F.coalesce("funding_sum", F.lit(0.0))})
    shape = T.StructType([*[f.schema[c] for c in keys], *[T.StructField(c, f.schema["timestamp"].dataType) for c in ("entry_time", "exit_time")], *T._parse_datatype_string(_MADE).fields])
    t = f.select(*bk, *_BAR, "st", *(("volatility_168", "momentum_168") if known else ())).groupBy(*bk).applyInArrow(_settled(keys, strategies, known), shape)
    side, close, held = F.col("side"), F.col("entry_price"), F.col("exit_idx") - F.col("entry_idx")
    t = t.withColumn("gross_return", side * (F.col("exit_price") - close) / close)
    t = t.withColumn("funding_bps", F.when(held > 0, (F.col("paid_after") - F.col("paid_before")) * side.cast("int") * 10_000).otherwise(0.0))
    at = F.array(*[F.lit(_starts(strategies).index(x.since)) for x in strategies])[F.col("k")]
    t = t.join(_since(frame, _starts(strategies), keys, s), keys).withColumn("adv", F.get("adv_", at)).where(F.get("bars_", at) >= s.min_segment_bars)
    t = t.join(spreads(book, s).select("symbol", "spread_bps"), "symbol", "left") if book is not None else t.withColumn("spread_bps", F.lit(s.fallback_spread_bps))
    cost = round_trip_cost(F.coalesce("spread_bps", F.lit(s.fallback_spread_bps)), impact_bps(F.lit(s.notional), F.coalesce("adv", F.lit(0.0)), s), F.col("funding_bps"), s)
    t = t.withColumn("cost_bps", cost)
    return t.select(
        F.array(*[F.lit(x.name) for x in strategies])[F.col("k")].alias("strategy"), *keys, "entry_idx", "exit_idx", "entry_time", "exit_time", side.cast("int").alias("side"), "entry_price", "exit_price", "atr", "barrier", held.alias("bars_held"), "gross_return",
        (F.col("gross_return") > 0).cast("int").alias("label"), "funding_bps", "cost_bps", (F.col("gross_return") - F.col("cost_bps") / 10_000).alias("net_return"), "regime",
    )


def with_features(events: DataFrame, frame: DataFrame, names: list[str]) -> DataFrame:
    """events with features of their entry bar, by symbol and time."""
    return events.join(frame.select("symbol", F.col("timestamp").alias("entry_time"), *names), ["symbol", "entry_time"], "left")


__all__ = ["BASE", "adv", "cumulative_funding", "funding_paid", "impact_bps", "round_trip_cost", "segment", "sides", "signals", "spreads", "trades", "with_features"]
