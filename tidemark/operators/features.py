"""The causal feature frame: blocks of each series, rolling statistics and a lag.

A series is numbered in spans of days and cut into blocks of BLOCK bars, each with the bars
before it that windows look at, so that one series is the work of many tasks.  Within a block
rolling statistics slide: a bar costs a constant, where Spark's sliding frames evaluate all
their rows for each row, some 5,600 updates a bar for all features.  Everything derived is lagged by one bar at the end, so what a bar carries was known at
the close of the bar before it.  Columns are built only if asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import regimes
from ..functions.spans import asof, numbered
from ..functions.windows import ewm, series
from ..sources.tables import BASE

MOMENTUM = (6, 24, 72, 168)
ATR_BARS = 14
#: Bars before a block that its windows may look at: the longest has 720, and of the recursive mean 1e-33 lies further back.
HALO = 1024
#: Bars of a block, a multiple of HALO: with 2048, half as many bars again are read for the blocks behind them.
BLOCK = 2048
#: Groups of symbols, each of which gets a copy of the benchmark.
GROUPS = 32


def indexed(bars: DataFrame, keys: list[str]) -> DataFrame:
    """bars with idx, the position in its series from 0, and n, the length of the series."""
    return numbered(bars, keys)


def true_range(w) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def average_true_range(df: DataFrame, keys: list[str], out: str = "atr") -> DataFrame:
    """Wilder's average of the true range; df has idx."""
    w = series(keys)
    return ewm(df.withColumn("tr_", true_range(w)), w, "tr_", 1 / ATR_BARS, ATR_BARS, "idx", keys, out).drop("tr_")


def in_blocks(df: DataFrame, keys: list[str], block: int = BLOCK, ahead: int = 0) -> tuple[DataFrame, list[str]]:
    """df in blocks of so many bars with the HALO bars before and the `ahead` bars behind them, and the keys that tell blocks apart.

    part_ says what a bar is to its block: -1 before it, 0 its own, 1 behind it.
    """
    if block < HALO or block % HALO or ahead > block:
        raise ValueError(f"a block is a multiple of {HALO} bars and as long as what is read ahead")
    at, j = F.floor(F.col("idx") / block).cast("int"), F.col("idx") % block
    last = (j >= block - HALO) & ((at + 1) * block < F.col("n") if "n" in df.columns else F.lit(True))
    copies = F.array_compact(F.array(F.lit(0), F.when(last, -1), F.when((j < ahead) & (at > 0), 1)))
    out = df.withColumn("part_", F.explode(copies))
    out = out.withColumn("block_", at - F.col("part_"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as blocks are much work and few bytes: they are not to be put together
    return out.repartition(tasks, *keys, "block_"), [*keys, "block_"]


def true_average(high: np.ndarray, low: np.ndarray, close: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Wilder's average of the true range of a block's bars; missing (NaN) for the first bars of a series."""
    before = np.concatenate([[np.nan], close[:-1]])
    tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
    return pd.Series(tr).ewm(alpha=1 / ATR_BARS, adjust=False).mean().where(idx >= ATR_BARS - 1).to_numpy()


def _derived(x: dict[str, pd.Series], idx: np.ndarray, want) -> dict[str, pd.Series]:
    """Every feature wanted, as known at the close of its bar, of one block in order of time; NaN is missing."""
    over = lambda a, b: a / b.where(b != 0)
    change = lambda v, n=1: over(v, v.shift(n)) - 1
    rolling = lambda v, n: v.rolling(n, min_periods=n)
    zscore = lambda v, n: over(v - rolling(v, n).mean(), rolling(v, n).std())
    close = x["close"]
    log = np.log(close.where(close > 0))
    out = {"return_1": change(close), "log_return": log - log.shift()}
    for n in MOMENTUM:
        if want(f"momentum_{n}"):
            out[f"momentum_{n}"] = change(close, n)
        if want(f"volatility_{n}"):
            out[f"volatility_{n}"] = rolling(out["log_return"], n).std()
    if want("return_zscore"):
        out["return_zscore"] = zscore(out["return_1"], 720)
    if want("quote_volume_z"):
        out["quote_volume_z"] = zscore(x["quote_volume"], 168)
    if "taker_buy_quote" in x and want("taker_buy_share", "taker_buy_share_z"):
        out["taker_buy_share"] = over(x["taker_buy_quote"], x["quote_volume"])
        out["taker_buy_share_z"] = zscore(out["taker_buy_share"], 168)
    if want("range_position"):
        low, high = rolling(x["low"], 24).min(), rolling(x["high"], 24).max()
        out["range_position"] = over(close - low, high - low)
    if "funding_rate" in x:
        out |= {"funding_rate": x["funding_rate"], "funding_z": zscore(x["funding_rate"], 168), "funding_cum_7d": rolling(x["funding_rate"], 21).sum()}
    if want("atr", "atr_pct"):
        out["atr"] = pd.Series(true_average(x["high"].to_numpy(), x["low"].to_numpy(), close.to_numpy(), idx))
        out["atr_pct"] = over(out["atr"], close)
    if "benchmark_close" in x:
        r, m = out["return_1"], change(x["benchmark_close"])
        beta = over(r.rolling(168, min_periods=168).cov(m.where(r.notna())), rolling(m, 168).var())
        out |= {"benchmark_close": x["benchmark_close"], "benchmark_return": m, "beta_168": beta, "residual_return": r - beta * m}
    return out


def feature_frame(bars: DataFrame, funding: DataFrame | None = None, benchmark: str | None = None, keys: list[str] | None = None, min_bars: int = 100, lagged: bool = True, only: set[str] | None = None, block: int = BLOCK) -> DataFrame:
    """bars with features, of the series of min_bars bars or more.

    funding(symbol, timestamp, funding_rate) is taken as of each bar.  benchmark names the
    symbol whose bars all others are compared with; it gets no such features itself.
    only: the features to build (what they rest on comes with them).  block: so many bars are
    a task's unit (a multiple of HALO, which is also what a block repeats of the one before).
    """
    keys = keys or ["symbol"]
    want = lambda *names: only is None or bool(only & set(names))
    df = indexed(bars, keys).where(F.col("n") >= min_bars)
    last = bars.agg(F.max("timestamp")).first()[0]
    if want("funding_rate", "funding_z", "funding_cum_7d"):
        df = df.withColumn("funding_rate", F.lit(None).cast("double")) if funding is None else asof(df, funding, ["symbol"], ["funding_rate"], times=last)
    if benchmark is not None and want("benchmark_close", "benchmark_return", "beta_168", "residual_return"):
        df = with_benchmark_close(df, bars, benchmark, last)
    read = [c for c in ("close", "high", "low", "quote_volume", "taker_buy_quote", "funding_rate", "benchmark_close") if c in df.columns]
    one = pd.Series([0.0])
    made = list(_derived({c: one for c in read}, np.zeros(1), want))
    kept = [c for c in df.columns if c not in (*made, "n") and (c in BASE or c == "idx")]
    others = [c for c in df.columns if c not in (*made, *kept, "n")]
    shape = T.StructType([*[df.schema[c] for c in kept + others], *[T.StructField(c, T.DoubleType()) for c in made]])

    def built(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        idx = t.column("idx").to_numpy()
        x = {c: pd.Series(np.asarray(t.column(c).to_numpy(zero_copy_only=False), float)) for c in read}
        with np.errstate(all="ignore"):
            new = _derived(x, idx, want)
        before = pa.array([None, *range(len(idx) - 1)] if lagged else range(len(idx)), pa.int64())
        columns = [t.column(c) for c in kept] + [t.column(c).take(before) for c in others] + [pa.array((new[c].shift() if lagged else new[c]).replace([np.inf, -np.inf], np.nan), from_pandas=True) for c in made]
        return pa.table(columns, names=shape.names).filter(pc.equal(t.column("part_"), 0))

    cut, bk = in_blocks(df, keys, block)
    return cut.groupBy(*bk).applyInArrow(built, shape)


def with_benchmark_close(df: DataFrame, bars: DataFrame, benchmark: str, last=None) -> DataFrame:
    """df with the benchmark's close as of each bar; null for the benchmark itself.

    Symbols are dealt into GROUPS, and the benchmark is written once for each of them.
    """
    bench = bars.where(F.col("symbol") == benchmark).select("timestamp", F.col("close").alias("benchmark_close"), F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group_"))
    own = F.when(F.col("symbol") == benchmark, -1).otherwise(F.pmod(F.hash("symbol"), F.lit(GROUPS)))
    return asof(df.withColumn("group_", own), bench, ["group_"], ["benchmark_close"], times=bars if last is None else last).drop("group_")


def regime(df: DataFrame, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """df, a frame with idx, and regime: volatile or calm, up or down; what is unknown counts as calm and down."""
    keys = keys or ["symbol"]
    names = ["idx", "volatility_168", "momentum_168"]
    cut, bk = in_blocks(df, keys, block)
    shape = T.StructType([*df.schema.fields, T.StructField("regime", T.StringType())])

    def labelled(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        _, vol, mom = (np.asarray(t.column(c).to_numpy(zero_copy_only=False), float) for c in names)
        t = t.append_column("regime", pa.array(regimes(vol, mom), pa.string()))
        return t.filter(pc.equal(t.column("part_"), 0)).select(shape.names)

    return cut.groupBy(*bk).applyInArrow(labelled, shape)
