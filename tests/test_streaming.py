"""Streams held against the same computation on whole tables."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import forecasts
from tidemark.streaming.resolution import STATE_STORE, resolved_stream

T0 = datetime(2024, 1, 1)
BARS = "symbol string, timestamp timestamp_ntz, high double, low double, close double"
FORECASTS = "id long, created_at timestamp_ntz, symbol string, direction string, horizon_hours int, entry_price double, target_price double, invalidation double"


def test_live_resolution_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    bars, made = [], []
    for s in "AB":
        price = 100.0
        for h in range(240):
            price *= 1 + rng.gauss(0, 0.01)
            bars.append((s, T0 + timedelta(hours=h), price * 1.006, price * 0.994, price))
            if h % 5 == 0 and h < 200:
                sign = rng.choice([1, -1])
                made.append((len(made), T0 + timedelta(hours=h), s, "long" if sign > 0 else "short", rng.choice([2, 12, 30]), price, price * (1 + sign * 0.02), price * (1 - sign * 0.015)))
    made.append((999, T0 + timedelta(hours=20), "C", "long", 5, 1.0, 2.0, 0.5))  # no bars
    # arrival: by hour, with every seventh bar three hours late; files in order of arrival
    seen = sorted([(b[1] + timedelta(hours=3 if i % 7 == 0 else 0), "bars", b) for i, b in enumerate(bars)] + [(f[1], "forecasts", f) for f in made], key=lambda x: x[0])
    for k in range(12):
        for kind, schema in (("bars", BARS), ("forecasts", FORECASTS)):
            own = [r for at, name, r in seen if name == kind and (at - T0) // timedelta(hours=21) == k]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
    stream = {kind: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / kind)) for kind, schema in (("bars", BARS), ("forecasts", FORECASTS))}
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        out = resolved_stream(stream["forecasts"], stream["bars"], "4 hours")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.set(STATE_STORE[0], before)
    assert q.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "outcome", "resolution", "last", "covered").collect())
    now = F.lit(T0 + timedelta(hours=239 - 4)).cast("timestamp_ntz")
    want = forecasts.resolve(spark.createDataFrame(made, FORECASTS), spark.createDataFrame(bars, BARS), now)
    want = sorted(tuple(r) for r in want.select("id", "outcome", "resolution", "last", "covered").collect())
    assert len(want) > 60 and got == want
    assert {r[2] for r in got} == {"invalidation hit first", "target hit first", "horizon expiry"}
