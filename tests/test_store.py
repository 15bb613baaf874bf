from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evolution, features, forecasts, signals, store, trades
from tidemark.sources import eventlog


def test_ledger(spark, tmp_path):
    led = store.Ledger(spark, str(tmp_path / "ledger"))
    assert led.trial_count() == 0
    h = led.register(author="a", title="t", economic_rationale="why", predicted_direction="long")
    with pytest.raises(ValueError):
        led.register(title="t", economic_rationale=" ", predicted_direction="long")
    with pytest.raises(ValueError):
        led.register(title="t", economic_rationale="x", predicted_direction="up")
    with pytest.raises(store.NotPreRegistered):
        led.record_test(99, passed=1)
    led.record_test(h, passed=0, n_trials=1, scorecard="{}")
    assert store.hypotheses_now(led.log("hypotheses"), led.log("tests")).first().status == "rejected"
    led.record_test(h, passed=1, n_trials=1, scorecard="{}")
    assert store.hypotheses_now(led.log("hypotheses"), led.log("tests")).first().status == "promoted"
    led.spend_holdout("x", passed=1)
    with pytest.raises(store.HoldoutExhausted):
        led.spend_holdout("x")
    led.archive(name="n", niche="a", fitness=1.0, passed=1)
    led.archive(name="n", niche="a", fitness=0.5, passed=0)
    assert [(r.fitness, r.status) for r in store.archive_latest(led.log("strategies")).collect()] == [(0.5, "active")]
    led.retire("n", "decayed")
    assert store.archive_latest(led.log("strategies")).first().status == "retired:decayed"


def test_evolution(spark, tmp_path):
    from test_engine import BARS, made_bars

    frame = features.feature_frame(spark.createDataFrame(made_bars(900), BARS))
    led = store.Ledger(spark, str(tmp_path / "l"))
    history = evolution.evolve(frame, led, generations=2, population=3, seeds=[signals.SMOKE, *signals.SEEDS[:2]])
    assert [h["generation"] for h in history] == [0, 1] and led.trial_count() == 6
    assert led.log("tests").count() == 6 and led.log("strategies").where("generation = 1 and parent is not null").count() == 3
    assert evolution.archive_latest(led.log("strategies")).where("created_at is null").count() == 0


def test_monitoring(spark, tmp_path):
    """Each strategy is scored on the bars since its own discovery, all in one plan."""
    from test_engine import BARS, made_bars

    frame = features.feature_frame(spark.createDataFrame(made_bars(1400), BARS))
    led = store.Ledger(spark, str(tmp_path / "l"))
    good, bad = '{"overall":{"mean_return":-0.01,"volatility":0.02}}', '{"overall":{"mean_return":0.5,"volatility":0.02}}'
    found = {"a": ("2024-01-08T00:00:00", good), "b": ("2024-01-15T00:00:00", bad), "c": ("2024-01-15T00:00:00", good)}
    rules = {n: signals.Rule(n, d, (signals.Condition("range_position", ">", 0.5),), h, 1.0, 1.0, "x") for n, d, h in (("a", "long", 6), ("b", "short", 12), ("c", "long", 24))}
    led.archive_all([{"name": n, "created_at": at, "genome": rules[n].genome(), "scorecard": card, "niche": "x", "fitness": 1.0, "passed": 1} for n, (at, card) in found.items()])
    got = {r.strategy: r for r in evolution.monitored(frame, store.archive_latest(led.log("strategies"))).collect()}
    for n, (at, _) in found.items():
        own = trades.trades(trades.segment(frame, since=F.lit(at).cast("timestamp_ntz")), [signals.compiled(rules[n])])
        want = own.agg(F.count("*").alias("n"), F.avg("net_return").alias("m")).first()
        assert got[n].n_trades == want.n and got[n].mean_return == pytest.approx(want.m, abs=1e-12)
    assert got["b"].status == "retire"
    assert "b" in evolution.retire_decayed(led, frame)
    last = {r.name: r.status for r in store.archive_latest(led.log("strategies")).collect()}
    assert last["b"] == "retired:sign_flip" and evolution.monitored(frame, store.archive_latest(led.log("strategies")).where("false")).count() == 0


def test_hypotheses_from_json(spark, tmp_path):
    from test_engine import BARS, made_bars

    frame = features.feature_frame(spark.createDataFrame(made_bars(900), BARS))
    led = store.Ledger(spark, str(tmp_path / "l"))
    for wrong in ("{", "[]", "{}", '{"name":"x","direction":"up","conditions":[]}', signals.replace(signals.SMOKE, rationale="").genome()):
        assert "error" in evolution.tested(wrong, frame, led)
    assert led.trial_count() == 0
    card = evolution.tested(signals.replace(signals.SMOKE, rationale="").genome(), frame, led, rationale="large moves revert")
    assert card["strategy"] == "smoke_meanrev" and card["n_trades"] > 0 and card["verdict"] in ("promote", "reject") and card["n_trials"] == 1 == led.trial_count()


def test_forecasts_in_the_store(spark, tmp_path):
    from test_engine import BARS, made_bars

    led = store.Ledger(spark, str(tmp_path / "l"))
    bars = spark.createDataFrame(made_bars(100, "A"), BARS)
    made = {"created_at": datetime(2024, 1, 1, 5), "agent_role": "a", "symbol": "A", "direction": "long", "probability": 0.7, "entry_price": 100.0, "target_price": 1e9, "invalidation": 0.0}
    first, second = led.record_forecast(**made, horizon_hours=24), led.record_forecast(**made, horizon_hours=24 * 30)
    with pytest.raises(ValueError):
        led.record_forecast(**{**made, "probability": 1.0}, horizon_hours=1)
    now = F.lit("2024-01-04").cast("timestamp_ntz")
    assert led.resolve_forecasts(bars, now, "later") == 1 and led.resolve_forecasts(bars, now) == 0
    assert [r.id for r in store.open_forecasts(led.log("forecasts"), led.log("resolutions")).collect()] == [second]
    state = store.forecasts_now(led.log("forecasts"), led.log("resolutions"))
    assert {r.id: r.outcome is None for r in state.collect()} == {first: False, second: True}
    assert store.forecast_summary(state).first().asDict() == {"total": 2, "resolved": 1, "open": 1}
    whole = store.research_state(led.log("hypotheses"), led.log("tests"), led.log("strategies"), state, led.log("holdout_access")).first()
    assert whole.forecasts.open == 1 and whole.ledger.total_hypotheses == 0 and whole.limits.holdout_budget == 1
    led.spend_holdout("x", accessed_at="t", passed=1)
    assert [r.strategy_name for r in store.holdout_history(led.log("holdout_access")).collect()] == ["x"]


def test_models(spark, tmp_path):
    import random

    from tidemark.operators import metalabel

    rng = random.Random(1)
    rows = [("s", x := rng.gauss(0, 1), None if k % 9 == 0 else rng.gauss(0, 1), int(x > 0)) for k in range(200)]
    data = spark.createDataFrame(rows, "strategy string, funding_z double, beta_168 double, meta_label int").fillna(0.0)
    at = str(tmp_path / "model")
    assert metalabel.loaded(spark, at) is None
    assert metalabel.success_probability(data, None).where("p_success is not null").count() == 0
    metalabel.trained(data, at, trees=5)
    odd = spark.createDataFrame([(1, 2.0, float("nan")), (2, -2.0, None), (3, None, 0.0)], "k int, funding_z double, beta_168 double")
    got = {r.k: r.p_success for r in metalabel.success_probability(odd, metalabel.loaded(spark, at)).collect()}
    assert got[1] > 0.8 and got[2] < 0.2 and 0 <= got[3] <= 1
    folds = spark.createDataFrame([(0, 0.6), (1, 0.54)], "fold int, auc double")
    assert metalabel.usable(folds).first().usable and not metalabel.usable(folds.limit(0)).first().usable


def test_series_in_files(spark, tmp_path):
    from test_engine import BARS, made_bars

    from tidemark.sources import tables

    root = str(tmp_path)
    bars = spark.createDataFrame(made_bars(20, "ABC"), BARS)
    for interval in ("1h", "4h"):
        tables.save_bars(bars, root, interval)
    got = tables.load_bars(spark, root, "1h", ["A", "C"])
    assert got.count() == 40 and got.select("symbol").distinct().count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "interval" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "symbol" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    for name, load, row in (("funding", tables.load_funding, "'A' AS symbol, timestamp_ntz'2024-01-01' AS timestamp, 0.1D AS funding_rate"), ("book", tables.load_book, "'A' AS symbol, 3.0D AS spread_bps")):
        spark.sql(f"SELECT {row} UNION ALL SELECT {row.replace(chr(39) + 'A', chr(39) + 'B')}").write.partitionBy("symbol").parquet(f"{root}/{name}")
        assert load(spark, root, ["B"]).count() == 1 and load(spark, root).count() == 2


def test_isotonic(spark):
    rows = [(i, "a", (i % 20 + 0.5) / 20, int((i * 7) % 20 < i % 20)) for i in range(400)] + [(1000 + i, "few", 0.9, 1) for i in range(3)]
    r = spark.createDataFrame(rows, "id int, agent_role string, probability double, outcome int")
    out = forecasts.calibrated(r.drop("outcome"), r).orderBy("probability").collect()
    ys = [x.calibrated for x in out if x.agent_role == "a"]
    assert ys == sorted(ys) and min(ys) >= 0.01 and max(ys) <= 0.99
    assert all(x.calibrated == pytest.approx(0.7) for x in out if x.agent_role == "few")
    for bad in (("up", 0.5), ("long", 1.0)):
        with pytest.raises(ValueError):
            forecasts.checked(*bad)


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    eventlog.append(spark.createDataFrame([("t0", "start", 1)], "ts string, type string, n int").coalesce(1), path)
    eventlog.append(spark.createDataFrame([("t1", "end", 2)], "ts string, type string, n int").coalesce(1), path)
    lines = eventlog.lines_of(spark, path)
    assert sorted(r.type for r in eventlog.read(lines).collect()) == ["end", "start"]
    assert eventlog.event_count(lines).first().n == 2 and sorted(r["index"] for r in lines.collect()) == [0, 1]
    many = eventlog.numbered(spark.range(1000).select(F.col("id").cast("string").alias("value"), "id").repartition(7), ["id"])
    assert all(r["index"] == r.id for r in many.collect())
    assert spark.range(1).select(eventlog.truncated(F.lit("  abcdef "), 3).alias("t")).first().t == "abc..."


def test_streamed_bars(spark, tmp_path):
    from tidemark.streaming.live import streamed_bars, tailed_log

    src = str(tmp_path / "ticks")
    spark.sql("SELECT 'A' AS symbol, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 3) AS ts, double(100 + id % 7) AS price, 1.0D AS volume FROM range(60)").write.parquet(src)
    q = streamed_bars(spark.readStream.schema("symbol string, ts timestamp_ntz, price double, volume double").parquet(src)).writeStream.format("memory").queryName("live_bars").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = spark.table("live_bars").orderBy("timestamp").collect()
    assert got and got[0].trades == 5 and got[0].open == 100.0 and got[0].close == 104.0 and got[0].high == 104.0
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text('{"ts":"1","type":"x"}\nnot json\n{"ts":"2","type":"y"}\n')
    q = tailed_log(spark, str(logs)).writeStream.format("memory").queryName("live_log").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert sorted(r.type for r in spark.table("live_log").collect()) == ["x", "y"]


def test_appended_frames_are_numbered_on(spark, tmp_path):
    led = store.Ledger(spark, str(tmp_path / "l"))
    rows = spark.range(1000).select(F.col("id").alias("forecast_id"), F.lit(1).alias("outcome"), F.lit("x").alias("resolution"), F.lit(None).cast("string").alias("resolved_at")).repartition(7)
    assert led.append_frame("resolutions", rows) == 1000 and led.append_frame("resolutions", rows.limit(0)) == 0 and led.append_frame("resolutions", rows.limit(3)) == 3
    assert sorted(r.id for r in led.log("resolutions").collect()) == list(range(1, 1004))


def test_written_tables_have_an_owner(spark, tmp_path):
    import os

    from tidemark.functions import kept

    root = kept.shared_root(spark).removeprefix("file:")
    with kept.scope():
        before = set(os.listdir(root)) if os.path.isdir(root) else set()
        a = kept.written(spark.range(5))
        with kept.scope():
            b = kept.written(a)
            assert b.count() == 5 and len(set(os.listdir(root)) - before) == 2
        assert len(set(os.listdir(root)) - before) == 1 and a.count() == 5
    assert set(os.listdir(root)) == before


def test_a_broken_strategy_is_named(spark):
    from test_engine import BARS, made_bars

    frame = features.feature_frame(spark.createDataFrame(made_bars(300, "A"), BARS), only={"momentum_6"})
    good = signals.Strategy("good", lambda df: F.lit(1))
    for bad in (signals.Strategy("bad", lambda df: F.col("no_such_column")), signals.Strategy("bad", lambda df: 1 / 0)):
        with pytest.raises(signals.StrategyError, match="^bad: "):
            trades.trades(frame, [good, bad])


def test_permutation_losses_against_a_loop(spark):
    import numpy as np

    from tidemark.operators import metalabel

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.5 * rng.normal(size=300) > 0).astype(int)
    rows = [(T0(i), "A", i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    t = spark.createDataFrame(rows, "entry_time timestamp_ntz, symbol string, entry_idx int, momentum_24 double, momentum_168 double, atr_pct double, meta_label int").repartition(3)
    model = metalabel.trained(t, trees=8)
    names = model.stages[0].getInputCols()
    assert [r.feature for r in metalabel.importances(model).collect()][0] == "momentum_24" and metalabel.importances(model).agg(F.sum("gain")).first()[0] == pytest.approx(1)
    got = {r.feature: r for r in metalabel.permuted(model, t).collect()}
    pdf = t.withColumn("h", F.xxhash64(F.struct("entry_time", "symbol", "entry_idx"), F.lit(0))).toPandas().sort_values("entry_idx")
    other = pdf.sort_values("h")

    def auc(p):
        up, down = p[pdf.meta_label == 1], p[pdf.meta_label == 0]
        return ((up[:, None] > down).mean() + (up[:, None] == down).mean() / 2).item()

    def scored(df):
        return np.array([r.probability[1] for r in sorted(model.transform(spark.createDataFrame(df)).select("entry_idx", "probability").collect(), key=lambda r: r.entry_idx)])

    base = auc(scored(pdf))
    for n in names:
        changed = pdf.copy()
        changed[n] = other[n].to_numpy()
        want = auc(scored(changed))
        assert got[n].auc == pytest.approx(want, abs=1e-12) and got[n].loss == pytest.approx(base - want, abs=1e-12)
    assert max(got.values(), key=lambda r: r.loss).feature == "momentum_24"


def T0(i):
    from datetime import timedelta

    return datetime(2024, 1, 1) + timedelta(hours=i)
