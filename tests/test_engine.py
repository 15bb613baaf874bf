"""Operators against small independent loops, and invariants that hold whatever the data."""

import math
import random
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions.normal import best_of, cdf
from tidemark.functions.order import quantiles
from tidemark.functions.spans import asof, numbered, running_sum
from tidemark.functions.windows import ewm, series
from tidemark.operators import evaluate, features, folds, market, metalabel, overfitting, signals, statistics, trades

T0 = datetime(2024, 1, 1)
BARS = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_quote double"


def made_bars(n, symbols="AB", seed=1):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for i, c in enumerate(close):
            hi, lo = c * (1 + abs(rng.normal(0, 0.01))), c * (1 - abs(rng.normal(0, 0.01)))
            q = float(rng.uniform(1e6, 2e6))
            rows.append((s, T0 + timedelta(hours=i), float(c), float(hi), float(lo), float(c), 10.0, q, 5, q * float(rng.uniform())))
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(made_bars(1100), BARS).repartition(4).cache()


@pytest.fixture(scope="module")
def pdf(bars):
    return bars.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)


def test_normal(spark):
    zs = [-40.0, -9.5, -7.2, -3.0, -0.5, 0.0, 0.3, 2.0, 7.5, 12.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(cdf(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [NormalDist().cdf(z) for z in zs], atol=1e-14, rtol=0)
    assert best_of(1) == 0 and best_of(100) == pytest.approx(2.5306, abs=1e-3)


def test_recursive_mean_and_true_range(spark, bars, pdf):
    df = features.average_true_range(features.indexed(bars, ["symbol"]), ["symbol"])
    got = df.toPandas().sort_values(["symbol", "timestamp"])["atr"].to_numpy()
    want = []
    for _, g in pdf.groupby("symbol"):
        pc = g["close"].shift()
        tr = pd.concat([g["high"] - g["low"], (g["high"] - pc).abs(), (g["low"] - pc).abs()], axis=1).max(axis=1)
        want.append(tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    assert np.allclose(got, pd.concat(want).to_numpy(), rtol=1e-12, equal_nan=True)
    one = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 3.0)], "symbol string, idx int, x double")
    assert [r.y for r in ewm(one, series(["symbol"], "idx"), "x", 0.5, 1, "idx", ["symbol"], "y").orderBy("idx").collect()] == [1.0, 2.0]


def test_features_against_pandas(bars, pdf):
    got = features.feature_frame(bars, benchmark="A").toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)
    for s, g in pdf.groupby("symbol"):
        g, own = g.reset_index(drop=True), got[got.symbol == s].reset_index(drop=True)
        ret, lr = g["close"].pct_change(), np.log(g["close"]).diff()
        want = {"momentum_24": g["close"].pct_change(24), "volatility_72": lr.rolling(72).std(), "return_zscore": (ret - ret.rolling(720).mean()) / ret.rolling(720).std(), "range_position": (g["close"] - g["low"].rolling(24).min()) / (g["high"].rolling(24).max() - g["low"].rolling(24).min())}
        if s == "B":
            b = pdf[pdf.symbol == "A"].reset_index(drop=True)["close"].pct_change()
            want["beta_168"] = ret.rolling(168).cov(b) / b.rolling(168).var()
        for k, v in want.items():
            assert np.allclose(own[k].astype(float), v.shift(1), rtol=1e-7, atol=1e-10, equal_nan=True), k
    assert got[got.symbol == "A"]["beta_168"].isna().all()


def test_truncation_changes_no_feature(bars):
    whole = features.feature_frame(bars)
    cut = features.feature_frame(bars.where(F.col("timestamp") < F.lit(T0 + timedelta(hours=900)).cast("timestamp_ntz")))
    a = cut.join(whole.select("symbol", "timestamp", F.col("return_zscore").alias("z"), F.col("atr").alias("a2")), ["symbol", "timestamp"])
    assert a.count() == 1800
    assert a.where(~F.col("return_zscore").eqNullSafe(F.col("z")) & (F.abs(F.col("return_zscore") - F.col("z")) > 1e-12) | (F.abs(F.col("atr") - F.col("a2")) > 1e-12)).count() == 0


def test_blocks_change_no_feature(spark):
    bars = spark.createDataFrame(made_bars(2600, "AB"), BARS)
    funding = bars.where("hour(timestamp) % 8 = 0").select("symbol", "timestamp", (F.col("volume") * 1e-5 + F.rand(3) * 1e-4).alias("funding_rate"))
    funding = spark.createDataFrame(funding.collect(), funding.schema)
    whole, cut = (features.feature_frame(bars, funding, "A", block=b).toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True) for b in (4096, 1024))
    assert sorted(whole.columns) == sorted(cut.columns) and len(whole) == len(cut) == 5200
    for c in whole.columns:
        if whole[c].dtype == float:
            assert np.allclose(whole[c], cut[c], rtol=1e-7, atol=1e-10, equal_nan=True), c
        else:
            assert (whole[c] == cut[c]).all(), c
    with pytest.raises(ValueError):
        features.feature_frame(bars, block=1000)


def test_asof(spark):
    rng = random.Random(3)
    at = lambda k: T0 + timedelta(minutes=k)
    left = [(rng.choice("AB"), at(k), k) for k in rng.sample(range(500), 200)]
    right = [(rng.choice("ABC"), at(k), float(k)) for k in rng.sample(range(500), 60)]
    got = asof(spark.createDataFrame(left, "symbol string, timestamp timestamp_ntz, k int"), spark.createDataFrame(right, "symbol string, timestamp timestamp_ntz, v double"), ["symbol"], ["v"])
    want = {(s, k): max((r for r in right if r[0] == s and r[1] <= t), key=lambda r: r[1], default=(0, 0, None))[2] for s, t, k in left}
    assert {(r.symbol, r.k): r.v for r in got.collect()} == want


def test_scans_in_spans(spark):
    rng = random.Random(9)
    rows = sorted({(rng.choice("AB"), T0 + timedelta(hours=rng.randint(0, 9000))) for _ in range(700)})
    df = spark.createDataFrame([(s, t, k, float(k % 7) if k % 5 else None) for k, (s, t) in enumerate(rows)], "symbol string, timestamp timestamp_ntz, k int, x double").repartition(5)
    for days in (1, 30, 5000):
        got = running_sum(numbered(df, ["symbol"], days=days), ["symbol"], "x", "total", days=days).toPandas().sort_values("k")
        for s, g in got.groupby("symbol"):
            assert list(g.idx) == list(range(len(g))) and set(g.n) == {len(g)}
            assert np.allclose(g.total, g.x.fillna(0).cumsum())
        late = df.where("k % 3 = 0").select("symbol", "timestamp", F.col("k").alias("v"))
        back = asof(df.where("k % 4 = 0"), late, ["symbol"], ["v"], days=days).toPandas()
        for r in back.itertuples():
            want = max((k for k, (s, t) in enumerate(rows) if s == r.symbol and k % 3 == 0 and t <= r.timestamp), default=None)
            assert (r.v == want) if want is not None else math.isnan(r.v)


def test_kernels_against_loops():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40, 257):
        high, low = rng.integers(0, 9, n).astype(float), rng.integers(-9, 1, n).astype(float)
        high[rng.random(n) < 0.1], low[rng.random(n) < 0.1] = np.nan, np.nan
        start = rng.integers(0, n, 60) + 1
        end = np.minimum(start - 1 + rng.integers(1, 50, 60), n - 1)
        below, above = rng.integers(-9, 0, 60).astype(float), rng.integers(1, 9, 60).astype(float)
        got = paths.first_touch(high, low, start, end, below, above)
        for i in range(60):
            touched = [j for j in range(start[i], end[i] + 1) if low[j] <= below[i] or high[j] >= above[i]]
            assert got[i] == (touched[0] if touched else end[i] + 1)
        v = rng.integers(0, 6, n).astype(float)
        v[rng.random(n) < 0.2] = np.nan
        window = pd.Series(v).rolling(20, min_periods=1)
        want = (v > window.median().to_numpy()) & (window.count().to_numpy() >= 5)
        assert (paths.above_median(v, 20, 5) == want).all()


def test_quantiles_and_ranks(spark):
    rng = random.Random(10)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), 0.0, -0.0, 1e300, -1e-300, 7.0])) for k in "abc" for _ in range(rng.randint(1, 400))] + [("d", None), ("e", 5.0), ("f", float("inf")), ("f", -float("inf")), ("f", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r.k: r for r in quantiles(df, ["k"], "x", {"low": 0.1, "mid": 0.5, "high": 0.75}).collect()}
    want = {r.k: r for r in df.groupBy("k").agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in (("low", 0.1), ("mid", 0.5), ("high", 0.75))]).where("mid is not null").collect()}
    assert got.keys() == want.keys() and all(got[k][c] == pytest.approx(want[k][c], rel=1e-15) for k in got if k != "f" for c in ("low", "mid", "high")) and got["f"].mid == 1
    scored = spark.createDataFrame([("s", rng.randint(0, 30) / 30, int(rng.random() < 0.4)) for _ in range(500)] + [("one", 0.5, 1)], "k string, p double, meta_label int")
    auc = {r.k: r.auc for r in metalabel.auc(scored, ["k"]).collect()}
    rows = [(r.p, r.meta_label) for r in scored.where("k = 's'").collect()]
    up, down = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert auc["one"] is None and auc["s"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down), rel=1e-12)


def test_correlations_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(market, "TILE", 3)
    names = [f"s{k}" for k in range(10)]
    bars = spark.createDataFrame(made_bars(90, names[:9]) + [("s9", T0 + timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0) for i in range(90)], BARS)
    got = {(r.a, r.b): r for r in market.correlations(bars).collect()}
    wide = bars.toPandas().pivot(index="timestamp", columns="symbol", values="close").pct_change().iloc[1:]
    want = wide.corr()
    assert sorted(got) == [(a, b) for a in names for b in names if a < b]
    for (a, b), r in got.items():
        assert r.n == 89 and (r.correlation is None if b == "s9" else r.correlation == pytest.approx(want.loc[a, b], rel=1e-9))


def test_drawdown_is_carried(spark):
    rng = random.Random(11)
    rows = [("s", "A", i, T0 + timedelta(days=i * 3), rng.gauss(-0.001, 0.05)) for i in range(600)]
    t = spark.createDataFrame(rows, "strategy string, symbol string, entry_idx int, entry_time timestamp_ntz, net_return double").repartition(4)
    eq = np.cumsum(np.log1p([r[4] for r in rows]))
    want = np.expm1(eq - np.maximum.accumulate(eq))
    got = statistics.drawdown(t, ["strategy"]).toPandas().sort_values("entry_idx")
    assert np.allclose(got.log_equity, eq) and np.allclose(got.drawdown, want)
    assert statistics.max_drawdown(t, ["strategy"]).first().max_drawdown == pytest.approx(want.min())


def loop_trades(g, atr, side, horizon, pt, sl):
    out, n = [], len(g)
    for i in range(n):
        if side[i] == 0 or not atr[i] > 0:
            continue
        c, s = g.close[i], side[i]
        target, stop = c + s * pt * atr[i], c - s * sl * atr[i]
        end = min(i + horizon, n - 1)
        price, j, kind = g.close[end], end, "vertical"
        for k in range(i + 1, end + 1):
            if (g.low[k] <= stop) if s > 0 else (g.high[k] >= stop):
                price, j, kind = stop, k, "stop"
                break
            if (g.high[k] >= target) if s > 0 else (g.low[k] <= target):
                price, j, kind = target, k, "target"
                break
        out.append((i, j, kind, s * (price - c) / c))
    return out


def test_barriers_against_a_loop(bars, pdf):
    frame = features.feature_frame(bars, only={"volatility_168", "momentum_168"})
    got = trades.trades(frame, [signals.ALTERNATING, signals.Strategy("short", lambda df: F.lit(-1), 9, 1.0, 2.0)]).toPandas()
    atrs = features.average_true_range(features.indexed(bars, ["symbol"]), ["symbol"]).toPandas().sort_values(["symbol", "timestamp"])
    for name, horizon, pt, sl in (("null_alternating", 24, 2.0, 1.0), ("short", 9, 1.0, 2.0)):
        for s, g in pdf.groupby("symbol"):
            g = g.reset_index(drop=True)
            side = [-1] * len(g) if name == "short" else [1 if i % 12 == 0 else -1 if i % 12 == 6 else 0 for i in range(len(g))]
            want = loop_trades(g, atrs[atrs.symbol == s]["atr"].to_numpy(), side, horizon, pt, sl)
            own = got[(got.strategy == name) & (got.symbol == s)].sort_values("entry_idx")
            assert [(a, b, c) for a, b, c, _ in want] == list(zip(own.entry_idx, own.exit_idx, own.barrier))
            assert np.allclose(own.gross_return, [w[3] for w in want], rtol=1e-10, atol=1e-14)
    assert (got.cost_bps >= 15).all() and np.allclose(got.net_return, got.gross_return - got.cost_bps / 1e4)


def made_trades(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = T0 + timedelta(hours=rng.randint(0, 900))
        rows.append(("s", "A", i, a, a + timedelta(hours=rng.randint(0, 30)), rng.gauss(0.001, 0.02), rng.gauss(0.002, 0.02), 20.0))
    return rows, spark.createDataFrame(rows, "strategy string, symbol string, entry_idx int, entry_time timestamp_ntz, exit_time timestamp_ntz, net_return double, gross_return double, cost_bps double").repartition(3)


def test_statistics_and_deflation(spark):
    rows, t = made_trades(spark)
    r = np.array([x[5] for x in sorted(rows, key=lambda x: (x[3], x[2]))])
    got = statistics.trade_statistics(t, ["strategy"]).first()
    eq = np.cumsum(np.log1p(r))
    want = {"n_trades": len(r), "win_rate": (r > 0).mean(), "mean_return": r.mean(), "median_return": np.median(r), "total_return": np.expm1(eq[-1]), "volatility": r.std(ddof=1), "sharpe": r.mean() / r.std(ddof=1), "profit_factor": r[r > 0].sum() / -r[r <= 0].sum(), "max_drawdown": np.expm1(eq - np.maximum.accumulate(eq)).min(), "avg_win": r[r > 0].mean(), "avg_loss": -r[r <= 0].mean()}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k
    d = statistics.deflated_sharpe(t, ["strategy"], 50).first()
    x = (r - r.mean()) / r.std()
    sr, skew, kurt = r.mean() / r.std(ddof=1), (x**3).mean(), (x**4).mean()
    z = (sr - best_of(50) / math.sqrt(len(r))) * math.sqrt(len(r) - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr**2)
    assert d.z == pytest.approx(z, rel=1e-9) and d.dsr == pytest.approx(NormalDist().cdf(z), abs=1e-12)


def compounding(spark):
    """Trades whose returns compound to almost nothing, or beyond any double, and the sums of their logarithms by strategy and regime."""
    made = [("loss", "calm", 300, -0.2), ("loss", "volatile", 170, -0.2), ("gain", "calm", 900, 2.0), ("gain", "volatile", 20, 0.1), ("ruin", "calm", 3, -5.0)]
    rows = [(name, "A", i, T0 + timedelta(hours=i), regime, r) for name, regime, n, r in made for i in range(n)]
    want = {(name, regime): n * math.log1p(max(r, -0.999999)) for name, regime, n, r in made}
    return spark.createDataFrame(rows, "strategy string, symbol string, entry_idx int, entry_time timestamp_ntz, regime string, net_return double").repartition(3), want


def test_log_total_return_of_any_size(spark):
    from tidemark.plans.queries import _stats

    t, parts = compounding(spark)
    want = {name: sum(v for k, v in parts.items() if k[0] == name) for name in ("loss", "gain", "ruin")}
    assert {r.strategy: r.log_total_return for r in _stats(t, ["strategy"]).collect()} == {k: pytest.approx(v, abs=1.1e-5) for k, v in want.items()}


def test_log_total_return_of_regimes(spark):
    from tidemark.plans.queries import _stats

    t, want = compounding(spark)
    got = {(r.strategy, r.regime): r.log_total_return for r in _stats(t, ["strategy", "regime"]).collect()}
    assert got == {k: pytest.approx(v, abs=1.1e-5) for k, v in want.items()}


def test_statistics_by_regime_equal_their_sql(spark):
    import duckdb

    from tidemark.plans.oracles import STAT, rs
    from tidemark.plans.oracles import stats as sql
    from tidemark.plans.queries import _stats

    made = [("loss", "calm", 300, -0.3), ("loss", "volatile", 70, -0.9), ("gain", "calm", 900, 2.0), ("mixed", "calm", 50, -0.03), ("mixed", "volatile", 20, -0.05), ("one", "calm", 1, 0.05)]
    rows = [(name, "A", i, T0 + timedelta(hours=i), regime, r + 0.01 * (i % 7)) for name, regime, n, r in made for i in range(n)]
    t = spark.createDataFrame(rows, "strategy string, symbol string, entry_idx int, entry_time timestamp_ntz, regime string, net_return double").repartition(3)
    frame = pd.DataFrame(rows, columns=t.columns)
    con = duckdb.connect()
    con.register("t", frame)
    want = con.execute(f"WITH {sql('strategy, regime')} SELECT strategy, regime, n_trades, {rs(STAT, 5)} FROM ts")
    got = _stats(t, ["strategy", "regime"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_constant_returns_never_pass(spark):
    rows = [("s", "A", i, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 1), 0.01, 0.02, 15.0) for i in range(60)]
    t = spark.createDataFrame(rows, "strategy string, symbol string, entry_idx int, entry_time timestamp_ntz, exit_time timestamp_ntz, net_return double, gross_return double, cost_bps double")
    card = evaluate.scorecards(t, 1).first()
    assert not card.passed and any("deflated" in x for x in card.rejection_reasons)


def test_folds_against_a_loop(spark):
    rows, t = made_trades(spark, 403)
    rows = sorted(rows, key=lambda x: (x[3], x[2]))
    n, got = len(rows), {r.fold: r for r in folds.walk_forward(t, ["strategy"]).collect()}
    assert sorted(got) == list(range(6))
    block = n // 7
    member = folds.members(t, ["strategy"]).toPandas()
    for k in range(1, 7):
        lo, hi = k * block, n if k == 6 else (k + 1) * block
        start = min(x[3] for x in rows[lo:hi])
        train = [i for i in range(lo) if rows[i][4] < start]
        barred = int(n * 0.01) if len(train) > int(n * 0.01) > 0 else 0
        f = got[k - 1]
        assert (f.purged, f.embargoed, f.n_train, f.n_trades) == (lo - len(train), barred, len(train) - barred, hi - lo)
        own = member[member.fold == k - 1]
        assert sorted(own[own.role == "train"].pos) == train[: len(train) - barred] and sorted(own[own.role == "test"].pos) == list(range(lo, hi))


def test_overfitting_against_a_loop(spark):
    from itertools import combinations

    rng = np.random.default_rng(2)
    m = rng.normal(0.001, 0.02, (101, 5))
    rows = [(f"s{j}", T0 + timedelta(days=i), float(m[i, j])) for i in range(101) for j in range(5)] + [("s0", T0 + timedelta(days=200), 0.1)]
    got = overfitting.overfitting(spark.createDataFrame(rows, "strategy string, day timestamp_ntz, r double")).first()
    blocks, logits = np.array_split(np.arange(101), 8), []
    for c in combinations(range(8), 4):
        i = np.concatenate([blocks[b] for b in c])
        o = np.setdiff1d(np.arange(101), i)
        sharpe = lambda x: x.mean(axis=0) / x.std(axis=0, ddof=1)
        best, out = sharpe(m[i]).argmax(), sharpe(m[o])
        p = min(max(pd.Series(out).rank(pct=True)[best], 1e-6), 1 - 1e-6)
        logits.append(math.log(p / (1 - p)))
    assert got.n_combinations == 70 and got.n_periods == 101
    assert got.pbo == pytest.approx(np.mean(np.array(logits) <= 0)) and got.median_logit == pytest.approx(np.median(logits))
    assert overfitting.overfitting(spark.createDataFrame(rows[:4], "strategy string, day timestamp_ntz, r double")).first().pbo is None


def test_funding_in_intervals(spark):
    rng = random.Random(4)
    fund = [("A", T0 + timedelta(hours=8 * k), rng.gauss(0, 1e-4)) for k in range(100)]
    spans = [(i, "A", T0 + timedelta(hours=a), T0 + timedelta(hours=a + rng.randint(0, 60))) for i, a in enumerate(rng.sample(range(-20, 780), 90))]
    got = trades.funding_paid(spark.createDataFrame(spans, "id int, symbol string, a timestamp_ntz, z timestamp_ntz"), spark.createDataFrame(fund, "symbol string, timestamp timestamp_ntz, funding_rate double"), "a", "z", ["id"])
    want = {i: sum(r for _, t, r in fund if a < t <= z) for i, _, a, z in spans}
    assert {r.id: pytest.approx(r.paid, abs=1e-12) for r in got.collect()} == want


def test_control_passes_and_nulls_do_not(bars):
    frame = features.feature_frame(bars, only={"volatility_168", "momentum_168"})
    cards, verdict = evaluate.null_suite(frame)
    v = verdict.first()
    assert v.trustworthy and v.nulls_passed == 0 and v.control_passed and v.nulls_evaluated >= 6
    assert 0 <= v.pbo <= 1


def test_rules():
    r = signals.SEEDS[0]
    assert signals.Rule.parse(r.genome()) == r and len(r.code_hash()) == 16
    assert r.code_hash() != signals.SEEDS[1].code_hash()
    for wrong in ({"direction": "up"}, {"conditions": ()}, {"horizon": 0}, {"pt_atr": 0.0}, {"conditions": (signals.Condition("price", ">", 1),)}, {"conditions": (signals.Condition("atr_pct", "=", 1),)}):
        from dataclasses import replace

        with pytest.raises(ValueError):
            replace(r, **wrong).checked()


def test_search_stays_within_valid_rules(bars):
    scale = signals.feature_scale(features.feature_frame(bars, only={"momentum_24", "return_zscore"}))
    assert {"momentum_24", "return_zscore"} <= set(scale) <= set(signals.FEATURES) and all(sd > 0 for _, sd in scale.values())
    rng = random.Random(7)
    pool = [*signals.SEEDS, *[signals.fresh_rule(rng, scale).checked() for _ in range(50)]]
    for k in range(600):
        pool.append((signals.neighbour(rng.choice(pool), rng, scale) if k % 3 else signals.blend(rng.choice(pool), rng.choice(pool), rng)).checked())
    assert len({r.name for r in pool}) == len(pool)
    assert signals.fresh_rule(random.Random(1)) == signals.fresh_rule(random.Random(1))


def test_a_rule_without_its_feature_is_flat(bars):
    frame = features.feature_frame(bars, only={"volatility_168", "momentum_168"})
    assert trades.signals(frame, [signals.compiled(signals.SEEDS[0])]).count() == 0
    with pytest.raises(ValueError):
        trades.segment(frame, "future")


def test_order_book_and_sizes(spark):
    b = spark.createDataFrame([("X", [(99.0, 1.0)], [(100.0, 1.0), (110.0, 100.0)])], "symbol string, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    r = market.order_book(b, 200.0).first()
    assert r.slippage_bps == pytest.approx((105.0 - 100) / 99.5 * 1e4) and r.fillable
    assert market.order_book(b, 50_000.0).first().fillable is False
