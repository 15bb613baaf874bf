"""Live resolution: forecasts and bars as streams, each forecast settled when the watermark has passed its deadline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESOLVED = "id bigint, outcome int, resolution string, last double, covered boolean"
#: What transformWithState keeps its state in; a session that runs resolved_stream() sets it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Resolver(StatefulProcessor):
    """Per symbol: the open forecasts, and the bars that one of them, or one still to come, may need.

    A timer stands at each deadline.  Until it fires, bars may come in any order, so what is late by
    less than the watermark's delay counts as if it had been in time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id bigint", "created bigint, deadline bigint, direction string, entry double, target double, stop double")
        self.bars = handle.getMapState("bars", "at bigint", "high double, low double, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for r in part.itertuples(index=False):
                if pd.isna(r.id):
                    self.bars.updateValue((int(r.at_ms),), (r.high, r.low, r.close))
                else:
                    deadline = int(r.at_ms) + int(r.horizon_hours) * 3_600_000
                    self.open.updateValue((int(r.id),), (int(r.at_ms), deadline, r.direction, r.entry_price, r.target_price, r.invalidation))
                    self.handle.registerTimer(deadline + 1)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.open.iterator())
        due = [(k[0], v) for k, v in held if v[1] < now]
        bars = sorted((k[0], *v) for k, v in self.bars.iterator())
        out = []
        for id, v in due:
            self.open.removeKey((id,))
            if (done := settled(v, bars)) is not None:
                out.append((id, *done))
        since = min([v[0] for _, v in held if v[1] >= now] + [timerValues.getCurrentWatermarkInMs()])
        for at, *_ in bars:
            if at <= since:
                self.bars.removeKey((at,))
        yield _rows(out)

    def close(self) -> None:
        pass


def _rows(out: list[tuple]) -> pd.DataFrame:
    kinds = {"id": "int64", "outcome": "int32", "resolution": object, "last": "float64", "covered": bool}
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pd.DataFrame({c: pd.Series(list(v), dtype=k) for (c, k), v in zip(kinds.items(), columns, strict=True)})


def settled(forecast: tuple, bars: list[tuple]):
    """(outcome, resolution, last, covered) of (created, deadline, direction, entry, target, stop) on bars in order of time; None without a bar."""
    created, deadline, direction, entry, target, stop = forecast
    long, last, seen = direction == "long", None, None
    outcome, note = None, "horizon expiry"
    for at, high, low, close in bars:
        if created < at <= deadline:
            last, seen = close, at
            if outcome is None:
                if (low <= stop) if long else (high >= stop):
                    outcome, note = 0, "invalidation hit first"
                elif (high >= target) if long else (low <= target):
                    outcome, note = 1, "target hit first"
    if seen is None:
        return None
    gain = last - entry if long else entry - last
    return (int(gain > 0) if outcome is None else outcome), note, last, seen >= deadline


def resolved_stream(forecasts: DataFrame, bars: DataFrame, late: str = "1 hour") -> DataFrame:
    """(id, outcome, resolution, last, covered) of streamed forecasts as forecasts.resolve() has them, each once, when the watermark is past its deadline.

    One watermark for both, `late` behind the latest row of either: bars and forecasts that are
    later than that are dropped.  A forecast without a bar before its deadline has no row.
    """
    time = lambda c: F.col(c).cast("timestamp")
    f = forecasts.select("symbol", time("created_at").alias("at"), "id", "direction", "horizon_hours", "entry_price", "target_price", "invalidation")
    b = bars.select("symbol", time("timestamp").alias("at"), "high", "low", "close")
    both = f.unionByName(b, allowMissingColumns=True).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return both.groupBy("symbol").transformWithStateInPandas(Resolver(), RESOLVED, "append", "EventTime")
