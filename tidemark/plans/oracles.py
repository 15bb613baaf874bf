"""DuckDB SQL for the catalogue, written apart from the plans: other formulas for the same results.

The recursive mean is a sum with geometric weights over all earlier bars; barriers are a
band join; funding is a range join; as-of joins are the engine's own.
"""

from __future__ import annotations

import math
from itertools import combinations

from ..functions.normal import FAR, LOWER, UPPER, best_of
from ..operators import metalabel, signals
from . import fixtures as fx
from .queries import BATCH, BENCHMARK, BOUNDARY, FEATURE_GROUPS, FRAME, NOW, RULES, TRIALS

BARS = """
bars AS (
  SELECT l_returnflag AS symbol, l_shipdate AS timestamp, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS quote_volume, count(*) AS trades, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS taker_buy_quote
  FROM (SELECT *, 100 + l_extendedprice / l_quantity / 1000 AS p, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY 1, 2
)"""
BARS15 = """
bars15 AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS timestamp, arg_min(p, ts) AS open, max(p) AS high, min(p) AS low, arg_max(p, ts) AS close,
    CAST(count(*) AS DOUBLE) AS volume, sum(p) AS quote_volume, count(*) AS trades, sum(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN p ELSE 0 END) AS taker_buy_quote
  FROM (SELECT *, 100 + 0.1::DOUBLE * value AS p FROM events) GROUP BY 1, 2
)"""
FUNDING = """
funding AS (SELECT l_returnflag AS symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS timestamp, avg(l_discount) - 0.05::DOUBLE AS funding_rate FROM lineitem GROUP BY 1, 2
), book AS (SELECT l_returnflag AS symbol, 100 * l_tax + 0.0 AS spread_bps FROM lineitem)"""


def roll(f: str, x: str, n: int, least: int | None = None, w: str = "symbol") -> str:
    frame = f"OVER (PARTITION BY {w} ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {f}({x}) {frame} END"


def z(x: str, n: int) -> str:
    return f"({x} - ({roll('avg', x, n)})) / nullif({roll('stddev_samp', x, n)}, 0)"


O = "OVER (PARTITION BY symbol ORDER BY timestamp)"  # noqa: E741
ATR = f"""CASE WHEN idx >= 13 THEN pow(13.0::DOUBLE / 14, idx) * sum(CASE WHEN idx = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 14 END * tr * pow(14.0::DOUBLE / 13, idx)) {O} END"""
TR = f"greatest(high - low, coalesce(abs(high - lag(close) {O}), 0), coalesce(abs(low - lag(close) {O}), 0))"


def frame(source: str = "bars", benchmark: bool = True, funding: bool = True) -> str:
    """CTEs f1 .. feats: the features, lagged by one bar."""
    changes = ", ".join(f"close / lag(close, {n}) {O} - 1 AS momentum_{n}, {roll('stddev_samp', 'log_return', n)} AS volatility_{n}" for n in (6, 24, 72, 168))
    fund = "SELECT f.*, g.funding_rate FROM f2 f ASOF LEFT JOIN funding g ON f.symbol = g.symbol AND f.timestamp >= g.timestamp" if funding else "SELECT *, NULL::DOUBLE AS funding_rate FROM f2"
    bench = f"SELECT f.*, g.close AS benchmark_close FROM f3 f ASOF LEFT JOIN (SELECT * FROM {source} WHERE symbol = '{BENCHMARK}') g ON f.timestamp >= g.timestamp WHERE f.symbol <> '{BENCHMARK}' UNION ALL BY NAME SELECT *, NULL::DOUBLE AS benchmark_close FROM f3 WHERE symbol = '{BENCHMARK}'" if benchmark else "SELECT *, NULL::DOUBLE AS benchmark_close FROM f3"
    b168 = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"
    lagged = ", ".join(f"lag({c}) {O} AS {c}" for c in FRAME)
    return f"""
f0 AS (SELECT * FROM (SELECT *, row_number() {O} - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM {source}) WHERE n >= 100
), f1 AS (SELECT *, close / lag(close) {O} - 1 AS return_1, ln(close) - ln(lag(close) {O}) AS log_return, {TR} AS tr, taker_buy_quote / nullif(quote_volume, 0) AS taker_buy_share FROM f0
), f2 AS (
  SELECT *, {changes}, {z('return_1', 720)} AS return_zscore, {ATR} AS atr, {z('quote_volume', 168)} AS quote_volume_z, {z('taker_buy_share', 168)} AS taker_buy_share_z,
    (close - ({roll('min', 'low', 24)})) / nullif(({roll('max', 'high', 24)}) - ({roll('min', 'low', 24)}), 0) AS range_position FROM f1
), f3 AS ({fund}
), f4 AS ({bench}
), f5 AS (SELECT *, atr / nullif(close, 0) AS atr_pct, {z('funding_rate', 168)} AS funding_z, {roll('sum', 'funding_rate', 21)} AS funding_cum_7d, benchmark_close / lag(benchmark_close) {O} - 1 AS benchmark_return FROM f4
), f6 AS (
  SELECT *, CASE WHEN count(CASE WHEN return_1 IS NOT NULL AND benchmark_return IS NOT NULL THEN 1 END) {b168} >= 168 AND count(benchmark_return) {b168} >= 168
    THEN covar_samp(return_1, benchmark_return) {b168} / nullif(var_samp(benchmark_return) {b168}, 0) END AS beta_168 FROM f5
), f7 AS (SELECT *, return_1 - beta_168 * benchmark_return AS residual_return FROM f6
), feats AS (SELECT symbol, timestamp, open, high, low, close, volume, quote_volume, trades, idx, {lagged} FROM f7)"""


BASE = f"WITH {BARS}, {FUNDING}, {frame()}"


def r(x: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round_even(({x}) * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE + 0.0 AS {alias or x}"  # half to even, as rint in the plans


def rs(names: list[str], digits: int = 6) -> str:
    return ", ".join(r(n, None, digits) for n in names)


REGIME = """CASE WHEN volatility_168 > m AND momentum_168 > 0 THEN 'volatile_up' WHEN volatility_168 > m THEN 'volatile_down' WHEN momentum_168 > 0 THEN 'calm_up' ELSE 'calm_down' END"""
SEG = f"""
seg AS (
  SELECT * EXCLUDE (tr), {ATR} AS atr, {REGIME} AS regime FROM (
    SELECT * EXCLUDE (atr, idx), row_number() {O} - 1 AS idx, {TR} AS tr, {roll('median', 'volatility_168', 720, 100)} AS m, count(*) OVER (PARTITION BY symbol) AS n FROM feats
  ) WHERE n >= 200
), adv AS (SELECT symbol, avg(quote_volume) * 24 AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS b FROM feats) WHERE b <= 720 GROUP BY symbol
), spr AS (SELECT symbol, CASE WHEN quantile_cont(spread_bps, 0.5) > 0 THEN quantile_cont(spread_bps, 0.75) ELSE 8 END AS spread FROM book GROUP BY symbol)"""


def sides(rule: signals.Rule) -> str:
    return f"CASE WHEN {' AND '.join(f'{c.feature} {c.op} {c.value!r}' for c in rule.conditions)} THEN {1 if rule.direction == 'long' else -1} ELSE 0 END"


def drawn(seed: int) -> str:
    u = f"((idx * 7919 + {seed * 104729 + 12345}) % 10007) / 10007.0::DOUBLE"
    return f"CASE WHEN {u} < 0.025 THEN 1 WHEN {u} < 0.05 THEN -1 ELSE 0 END"


SIDES = {r_.name: (sides(r_), r_.horizon, r_.pt_atr, r_.sl_atr) for r_ in RULES.values()} | {
    **{f"null_random_{i}": (drawn(1000 + i), 24, 2.0, 1.0) for i in range(5)},
    "null_always_long": ("CASE WHEN idx % 24 = 0 THEN 1 ELSE 0 END", 24, 2.0, 1.0),
    "null_alternating": ("CASE WHEN idx % 12 = 0 THEN 1 WHEN idx % 12 = 6 THEN -1 ELSE 0 END", 24, 2.0, 1.0),
    "positive_control_lookahead": (f"coalesce(sign(lead(close) {O} / close - 1), 0)", 24, 2.0, 1.0),
    "every_long": ("1", 24, 2.0, 1.0), "every_short": ("-1", 12, 1.5, 1.0), "long_6": ("1", 6, 1.0, 1.0), "short_48": ("-1", 48, 3.0, 2.0),
}


def trades(names: list[str], costs: bool = True, seg: str = SEG) -> str:
    """CTEs seg .. t: the trades of some strategies."""
    sig = " UNION ALL ".join(f"SELECT '{n}' AS strategy, symbol, idx, CAST({SIDES[n][0]} AS DOUBLE) AS side, {SIDES[n][1]} AS h, {SIDES[n][2]!r}::DOUBLE AS pt, {SIDES[n][3]!r}::DOUBLE AS sl FROM seg" for n in names)
    paid = "coalesce((SELECT sum(g.funding_rate) FROM funding g WHERE g.symbol = x.symbol AND g.timestamp > x.entry_time AND g.timestamp <= x.exit_time), 0) * side * 10000" if costs else "0.0::DOUBLE"
    spread = "(SELECT spread FROM spr WHERE spr.symbol = y.symbol)" if costs else "8.0::DOUBLE"
    return f"""{seg}, sig AS (SELECT * FROM ({sig}) WHERE side <> 0
), e AS (
  SELECT s.*, b.timestamp AS entry_time, b.close AS entry_price, b.atr, b.regime, b.n AS bars, CASE WHEN side > 0 THEN b.close + pt * b.atr ELSE b.close - pt * b.atr END AS target, CASE WHEN side > 0 THEN b.close - sl * b.atr ELSE b.close + sl * b.atr END AS stop
  FROM sig s JOIN seg b USING (symbol, idx) WHERE b.atr > 0
), hit AS (
  SELECT e.strategy, e.symbol, e.idx, min(b.idx) AS j, arg_min(CASE WHEN e.side > 0 THEN b.low <= e.stop ELSE b.high >= e.stop END, b.idx) AS stopped
  FROM e JOIN seg b ON b.symbol = e.symbol AND b.idx > e.idx AND b.idx <= e.idx + e.h
  WHERE CASE WHEN e.side > 0 THEN b.low <= e.stop OR b.high >= e.target ELSE b.high >= e.stop OR b.low <= e.target END GROUP BY 1, 2, 3
), x AS (
  SELECT e.*, o.idx AS exit_idx, o.timestamp AS exit_time, CASE WHEN h.j IS NULL THEN 'vertical' WHEN h.stopped THEN 'stop' ELSE 'target' END AS barrier,
    CASE WHEN h.j IS NULL THEN o.close WHEN h.stopped THEN e.stop ELSE e.target END AS exit_price
  FROM e LEFT JOIN hit h ON h.strategy = e.strategy AND h.symbol = e.symbol AND h.idx = e.idx JOIN seg o ON o.symbol = e.symbol AND o.idx = coalesce(h.j, least(e.idx + e.h, e.bars - 1))
), y AS (SELECT *, side * (exit_price - entry_price) / entry_price AS gross_return, {paid} AS funding_bps FROM x
), t AS (
  SELECT strategy, symbol, idx AS entry_idx, exit_idx, entry_time, exit_time, CAST(side AS INT) AS side, entry_price, exit_price, atr, barrier, exit_idx - idx AS bars_held, gross_return, CAST(gross_return > 0 AS INT) AS label,
    funding_bps, cost AS cost_bps, gross_return - cost / 10000 AS net_return, regime
  FROM (SELECT *, greatest(15.0::DOUBLE, 10 + {spread} * 1.5::DOUBLE + 2 * 40 * sqrt(1000.0::DOUBLE / (SELECT adv FROM adv WHERE adv.symbol = y.symbol)) + funding_bps) AS cost FROM y)
)"""


EVENTS = [s.name for s in BATCH]
TRADES = f"{BASE}, {trades(EVENTS)}"
LABELS = f"strategy, symbol, entry_idx, exit_idx, entry_time, exit_time, side, {rs(['entry_price', 'exit_price', 'atr'])}, barrier, bars_held, {r('gross_return')}, label"


def stats(keys: str, digits: int = 5) -> str:
    return f"""
eq AS (SELECT *, sum(ln(1 + greatest(net_return, -0.999999))) OVER (PARTITION BY {keys} ORDER BY entry_time, symbol, entry_idx) AS log_equity FROM t
), dd AS (SELECT *, exp(log_equity - max(log_equity) OVER (PARTITION BY {keys} ORDER BY entry_time, symbol, entry_idx)) - 1 AS drawdown FROM eq
), st AS (
  SELECT {keys}, count(*) AS n_trades, avg(CAST(net_return > 0 AS DOUBLE)) AS win_rate, avg(net_return) AS mean_return, median(net_return) AS median_return, sum(ln(1 + greatest(net_return, -0.999999))) AS log_total_return,
    coalesce(stddev_samp(net_return), 0) AS volatility, coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0), 0) AS sharpe,
    coalesce(sum(net_return) FILTER (WHERE net_return > 0), 0) AS gw, coalesce(-sum(net_return) FILTER (WHERE net_return <= 0), 0) AS gl,
    min(drawdown) AS max_drawdown, coalesce(avg(net_return) FILTER (WHERE net_return > 0), 0) AS avg_win, coalesce(-avg(net_return) FILTER (WHERE net_return <= 0), 0) AS avg_loss
  FROM dd GROUP BY {keys}
), ts AS (SELECT *, CASE WHEN gl > 0 THEN gw / gl ELSE 'inf'::DOUBLE END AS profit_factor, CASE WHEN avg_loss > 0 THEN avg_win / avg_loss ELSE 'inf'::DOUBLE END AS payoff_ratio FROM st)"""


STAT = ["win_rate", "mean_return", "median_return", "log_total_return", "volatility", "sharpe", "profit_factor", "max_drawdown", "avg_win", "avg_loss", "payoff_ratio"]

FOLDS = """
o AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY entry_time, symbol, entry_idx) - 1 AS pos, count(*) OVER (PARTITION BY strategy) AS n FROM t
), k AS (SELECT *, n // 7 AS block, CASE WHEN pos >= n // 7 THEN least(pos // (n // 7), 6) END AS fold FROM o WHERE n >= 12
), te AS (SELECT strategy, fold, min(entry_time) AS test_start, max(exit_time) AS test_end, min(pos) AS lo, any_value(n) AS n, count(*) AS n_trades, avg(CAST(net_return > 0 AS DOUBLE)) AS win_rate, avg(net_return) AS mean_return, coalesce(avg(net_return) / nullif(stddev_samp(net_return), 0), 0) AS sharpe FROM k WHERE fold IS NOT NULL GROUP BY 1, 2
), tr AS (SELECT te.strategy, te.fold, count(*) FILTER (WHERE k.exit_time >= te.test_start) AS purged, count(*) FILTER (WHERE k.exit_time < te.test_start) AS kept FROM te JOIN k ON k.strategy = te.strategy AND k.pos < te.lo GROUP BY 1, 2
), fo AS (
  SELECT strategy, CAST(fold - 1 AS INT) AS fold, test_start, test_end, kept - em AS n_train, purged, em AS embargoed, n_trades, win_rate, mean_return, sharpe
  FROM (SELECT te.*, tr.purged, tr.kept, CASE WHEN CAST(floor(te.n * 0.01) AS BIGINT) > 0 AND tr.kept > CAST(floor(te.n * 0.01) AS BIGINT) THEN CAST(floor(te.n * 0.01) AS BIGINT) ELSE 0 END AS em FROM te JOIN tr USING (strategy, fold)) WHERE kept - em > 0
), fc AS (SELECT strategy, avg(sharpe) AS mean_sharpe, stddev_pop(sharpe) AS std_sharpe, count(*) FILTER (WHERE sharpe > 0) AS positive_folds, count(*) AS total_folds FROM fo GROUP BY strategy)"""


def horner(x: str, c: tuple) -> str:
    out = repr(c[0])
    for k in c[1:]:
        out = f"({x} * {out} + {k!r})"
    return out


def phi(v: str) -> str:
    x = f"abs({v})"
    near = f"exp(-{x} * {x} / 2) * {horner(x, UPPER)} / {horner(x, LOWER)}"
    far = f"exp(-{x} * {x} / 2) / ({x} + 1.0 / ({x} + 2.0 / ({x} + 3.0 / ({x} + 4.0 / ({x} + 0.65))))) / 2.506628274631"
    below = f"(CASE WHEN {x} < {FAR!r} THEN {near} ELSE {far} END)"
    return f"CASE WHEN {v} > 0 THEN 1 - {below} ELSE {below} END"


def moments(best: str) -> str:
    return f"""
mo AS (SELECT strategy, count(*) AS n_obs, avg(net_return) AS m, stddev_samp(net_return) AS sd, stddev_pop(net_return) AS sp FROM t GROUP BY strategy
), sk AS (SELECT strategy, avg(pow((net_return - m) / nullif(sp, 0), 3)) AS skew, avg(pow((net_return - m) / nullif(sp, 0), 4)) AS kurtosis FROM t JOIN mo USING (strategy) GROUP BY strategy
), d0 AS (SELECT *, CASE WHEN n_obs < 3 THEN 0 ELSE coalesce(m / nullif(sd, 0), 0) END AS sharpe, CASE WHEN n_obs < 3 THEN 0 ELSE {best} / sqrt(n_obs) END AS sharpe_threshold FROM mo JOIN sk USING (strategy)
), d1 AS (SELECT *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe AS v FROM d0
), d2 AS (SELECT *, CASE WHEN n_obs >= 3 AND v > 0 THEN (sharpe - sharpe_threshold) * sqrt(n_obs - 1) / sqrt(CASE WHEN v > 0 THEN v END) END AS z FROM d1
), ds AS (SELECT *, CASE WHEN n_obs < 3 OR v <= 0 THEN 0 ELSE {phi('z')} END AS dsr FROM d2)"""


MOMENTS = moments(repr(best_of(TRIALS)))


def cards(trades: str, moments: str) -> str:
    return f"""{trades}, {stats('strategy')}, {FOLDS}, {moments}, cd AS (SELECT strategy, avg(cost_bps) AS mean_cost_bps, avg(cost_bps) / 10000 / abs(nullif(avg(gross_return), 0)) AS cost_drag_ratio FROM t GROUP BY strategy
), c0 AS (SELECT ts.*, ds.dsr, cd.mean_cost_bps, coalesce(cd.cost_drag_ratio, 'inf'::DOUBLE) AS cost_drag_ratio, fc.positive_folds, fc.total_folds FROM ts JOIN ds USING (strategy) JOIN cd USING (strategy) LEFT JOIN fc USING (strategy)
), c1 AS (
  SELECT *, list_filter([CASE WHEN n_trades < 30 THEN 'only ' || n_trades || ' trades, need 30' END, CASE WHEN mean_return <= 0 THEN 'net mean return is not positive after costs' END,
    CASE WHEN coalesce(dsr, 0) < 0.95 THEN 'deflated Sharpe probability ' || printf('%.3f', coalesce(dsr, 0)) || ' < 0.95' END,
    CASE WHEN positive_folds < total_folds * 0.6 THEN 'only ' || positive_folds || '/' || total_folds || ' folds positive' END,
    CASE WHEN cost_drag_ratio > 0.8 THEN 'costs consume ' || CASE WHEN isinf(cost_drag_ratio) THEN 'inf' ELSE CAST(CAST(round(cost_drag_ratio * 100) AS BIGINT) AS VARCHAR) END || '% of gross edge' END], lambda x: x IS NOT NULL) AS reasons FROM c0
), cards AS (SELECT *, len(reasons) = 0 AS passed, CASE WHEN len(reasons) = 0 THEN 'promote' ELSE 'reject' END AS verdict FROM c1)"""


CARDS = cards(TRADES, MOMENTS)


def pbo(inner: str, s: int = 8) -> str:
    combos = ", ".join(f"({i}, {[int(b in c) for b in range(s)]})" for i, c in enumerate(combinations(range(s), s // 2)))
    return f"""{inner}, dr AS (SELECT strategy, CAST(date_trunc('day', entry_time) AS TIMESTAMP) AS day, avg(net_return) AS r FROM t GROUP BY 1, 2
), fu AS (SELECT * FROM dr WHERE day IN (SELECT day FROM dr GROUP BY day HAVING count(*) = (SELECT count(DISTINCT strategy) FROM dr))
), bl AS (SELECT day, ntile({s}) OVER (ORDER BY day) - 1 AS block FROM (SELECT DISTINCT day FROM fu)
), co AS (SELECT * FROM (VALUES {combos}) v(combo, mask)
), pf AS (SELECT combo, strategy, mask[block + 1] AS inside, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) AS sharpe FROM fu JOIN bl USING (day), co GROUP BY 1, 2, 3
), pr AS (SELECT combo, strategy, max(sharpe) FILTER (WHERE inside = 1) AS i, max(sharpe) FILTER (WHERE inside = 0) AS o FROM pf GROUP BY 1, 2
), rk AS (SELECT *, (rank() OVER (PARTITION BY combo ORDER BY o) + (count(*) OVER (PARTITION BY combo, o) - 1) / 2.0) / count(*) OVER (PARTITION BY combo) AS pct, row_number() OVER (PARTITION BY combo ORDER BY i DESC, strategy) AS place FROM pr
), lg AS (SELECT ln(p / (1 - p)) AS logit FROM (SELECT least(1 - 1e-6, greatest(1e-6, CAST(pct AS DOUBLE))) AS p FROM rk WHERE place = 1)
), pb AS (SELECT avg(CAST(logit <= 0 AS DOUBLE)) AS pbo, median(logit) AS median_logit, count(*) AS n_combinations FROM lg)"""


VALS = fx.values
HYP = "hyp AS (SELECT p_partkey + 1 AS id, p_name || ' ' || p_size AS title, replace(p_name, ' ', '_') || ' pays ' || p_size || '%' AS statement, p_type || ' of ' || p_brand AS economic_rationale, CASE p_partkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'both' END AS predicted_direction FROM part)"
TST = "tst AS (SELECT event_id + 1 AS id, user_id + 1 AS hypothesis_id, event_id % 20 + 1 AS n_trials, CAST(event_type = 'purchase' AS INT) AS passed, event_id % 90 AS n_trades, CAST(event_id % 41 AS DOUBLE) / 8 - 2 AS sharpe, 'saw ' || event_type AS first_reason FROM events)"
STS = "now AS (SELECT h.id, h.title, CASE WHEN l.p IS NULL THEN 'registered' WHEN l.p = 1 THEN 'promoted' ELSE 'rejected' END AS status FROM hyp h LEFT JOIN (SELECT hypothesis_id, arg_max(passed, id) AS p FROM tst GROUP BY 1) l ON l.hypothesis_id = h.id)"
STRAT = """strat AS (
  SELECT o_orderkey + 1 AS id, 'strategy_' || o_custkey AS name, o_orderkey % 7 AS generation, o_totalprice / 1000000 AS fitness, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS passed, CASE o_orderstatus WHEN 'P' THEN 'retired:decayed' ELSE 'active' END AS status, CAST(o_orderkey % 41 AS DOUBLE) / 8 - 2 AS sharpe,
    CASE WHEN o_orderkey % 6 < 2 THEN 'intraday' WHEN o_orderkey % 6 < 4 THEN 'swing' ELSE 'position' END || '|' || CASE o_orderkey % 5 WHEN 0 THEN 'funding' WHEN 1 THEN 'flow' WHEN 2 THEN 'relative' WHEN 3 THEN 'volatility' ELSE 'price' END || '|' || CASE o_custkey % 2 WHEN 0 THEN 'long' ELSE 'short' END AS niche
  FROM orders
), arch AS (SELECT * FROM strat QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1)"""
HOLD = "hold AS (SELECT c_custkey + 1 AS id, lower(c_mktsegment) || '_' || c_nationkey AS strategy_name, CAST(NULL AS VARCHAR) AS accessed_at, CAST(c_acctbal > 9000 AS INT) AS passed FROM customer)"
LOG = "ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS type FROM events)"
BOOKS = """lv AS (
  SELECT l_orderkey AS symbol, round(100 * l_discount) AS level, true AS ask, sum(l_quantity) / 8 AS qty FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_orderkey, round(100 * l_tax), false, sum(l_quantity) / 8 FROM lineitem GROUP BY 1, 2
), b AS (SELECT symbol, list({'price': 100 - (level + 1) / 2, 'qty': qty} ORDER BY level) FILTER (WHERE NOT ask) AS bids, list({'price': 100 + (level + 1) / 2, 'qty': qty} ORDER BY level) FILTER (WHERE ask) AS asks FROM lv GROUP BY 1)"""


def wins(source: str, keys: str) -> str:
    """CTEs wp and sz: the record of each group and the size it allows."""
    return f"""wp AS (SELECT {keys}, avg(CAST(r > 0 AS INT)) AS p, avg(r) FILTER (WHERE r > 0) / avg(-r) FILTER (WHERE r < 0) AS payoff FROM (SELECT *, close / lag(close) {O} - 1 AS r FROM {source}) WHERE r IS NOT NULL GROUP BY ALL
), sz AS (SELECT *, 1 / (1 + payoff) AS breakeven, CASE WHEN payoff IS NULL THEN 0 ELSE greatest(0, p - (1 - p) / payoff) END AS kelly FROM wp)"""



FC = f"""{BARS}, fc AS (
  SELECT CASE symbol WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 100000 + idx AS id, timestamp AS created_at, 'agent_' || (idx % 5) AS agent_role, symbol, CASE WHEN idx % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
    (idx * 7919 % 97 + 1) / 98.0::DOUBLE AS probability, idx % 4 * 48 + 24 AS horizon_hours, close AS entry_price, close + CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END * 0.8::DOUBLE AS target_price, close - CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END * 0.6::DOUBLE AS invalidation, CASE WHEN idx % 7 < 3 THEN 'calm' ELSE 'wild' END AS regime
  FROM (SELECT *, row_number() {O} - 1 AS idx FROM bars) WHERE idx % 3 = 0 AND idx > 100
), fw AS (
  SELECT f.*, b.timestamp AS ts, b.close, f.created_at + to_hours(f.horizon_hours) AS deadline, CASE WHEN direction = 'long' THEN CASE WHEN b.low <= invalidation THEN 0 WHEN b.high >= target_price THEN 1 END ELSE CASE WHEN b.high >= invalidation THEN 0 WHEN b.low <= target_price THEN 1 END END AS hit
  FROM fc f JOIN bars b ON b.symbol = f.symbol AND b.timestamp > f.created_at AND b.timestamp <= f.created_at + to_hours(f.horizon_hours) WHERE f.created_at + to_hours(f.horizon_hours) <= TIMESTAMP '{NOW}'
), fr AS (SELECT id, arg_min(hit, ts) FILTER (WHERE hit IS NOT NULL) AS hit, arg_max(close, ts) AS last, max(ts) AS seen, any_value(entry_price) AS entry_price, any_value(direction) AS direction, any_value(deadline) AS deadline FROM fw GROUP BY id
), rf AS (SELECT id, CAST(coalesce(hit, CAST(CASE WHEN direction = 'long' THEN last - entry_price ELSE entry_price - last END > 0 AS INT)) AS INT) AS outcome, CASE hit WHEN 0 THEN 'invalidation hit first' WHEN 1 THEN 'target hit first' ELSE 'horizon expiry' END AS resolution, last, seen >= deadline AS covered FROM fr
), fj AS (SELECT fc.*, rf.outcome FROM fc LEFT JOIN rf USING (id))"""


def scores(keys: str) -> str:
    return f"""sc AS (
  SELECT {keys}, count(*) AS n, avg(outcome) AS base_rate, avg(probability) AS mean_probability, avg(pow(probability - outcome, 2)) AS brier, -avg(outcome * ln(probability + 1e-12) + (1 - outcome) * ln(1 - probability + 1e-12)) AS log_loss FROM fj WHERE outcome IS NOT NULL GROUP BY {keys}
), s2 AS (SELECT *, base_rate * (1 - base_rate) AS brier_base_rate, mean_probability - base_rate AS overconfidence FROM sc
), s3 AS (SELECT *, CASE WHEN brier_base_rate > 0 THEN 1 - brier / brier_base_rate ELSE 0 END AS skill_score FROM s2)
SELECT {keys}, n, {rs(['base_rate', 'mean_probability', 'brier', 'brier_base_rate', 'overconfidence', 'skill_score', 'log_loss'])}, CASE WHEN n >= 25 AND skill_score > 0 THEN 'voting' WHEN n >= 25 THEN 'demoted' ELSE 'provisional' END AS status FROM s3"""


RECENT = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS back"
COSTS = f"co AS (SELECT symbol, greatest(15.0::DOUBLE, 10 + spread * 1.5::DOUBLE + 80 * sqrt(1000.0::DOUBLE / adv)) AS round_trip_bps, adv, spread FROM (SELECT symbol, avg(quote_volume) * 24 AS adv FROM ({RECENT} FROM bars) WHERE back <= 720 GROUP BY 1) JOIN (SELECT symbol, CASE WHEN quantile_cont(spread_bps, 0.5) > 0 THEN quantile_cont(spread_bps, 0.75) ELSE 8 END AS spread FROM book GROUP BY 1) USING (symbol))"


def corr(source: str) -> str:
    return f"""r0 AS (SELECT symbol, timestamp, close / lag(close) {O} - 1 AS r FROM {source}
), r1 AS ({RECENT} FROM r0 WHERE r IS NOT NULL
), r2 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM r1 WHERE back <= 720) WHERE k > 50
), r3 AS (SELECT * FROM r2 WHERE timestamp IN (SELECT timestamp FROM r2 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM r2))
), cp AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS correlation, count(*) AS n FROM r3 x JOIN r3 y ON x.timestamp = y.timestamp AND x.symbol < y.symbol GROUP BY 1, 2)"""


CTX = list(metalabel.CONTEXT)
META = f"{BASE}, {trades(['null_alternating'])}, me AS (SELECT t.*, {', '.join(f'coalesce(f.{c}, 0) AS {c}' for c in CTX)}, CAST(net_return > 0 AS INT) AS meta_label FROM t JOIN (SELECT * EXCLUDE (atr) FROM feats) f ON f.symbol = t.symbol AND f.timestamp = t.entry_time)"
GUARD = ["momentum_6", "momentum_24", "return_zscore", "quote_volume_z", "range_position"]
_since, _until = "feats WHERE timestamp >= TIMESTAMP '1996-01-01'", "feats WHERE timestamp < TIMESTAMP '1996-01-01'"


def cut(source: str) -> str:
    return SEG.replace("FROM feats\n", f"FROM (SELECT * FROM {source})\n").replace("FROM feats)", f"FROM {source})")


def part(source: str) -> str:
    return f"({BASE}, {trades(EVENTS, False, cut(source))} SELECT * FROM t)"


def segment(kind: str) -> str:
    limit = {"research": f" AND timestamp < TIMESTAMP '{BOUNDARY}'", "holdout": f" AND timestamp >= TIMESTAMP '{BOUNDARY}'", "all": ""}[kind]
    return f"SELECT '{kind}' AS segment, symbol, count(*) AS n, min(entry_time) AS first, max(exit_time) AS last, {r('avg(gross_return)', 'mean_gross')} FROM ({BASE}, {trades(['null_alternating'], False, cut(chr(40) + 'SELECT * FROM feats WHERE timestamp >= TIMESTAMP ' + chr(39) + '1993-01-01' + chr(39) + limit + chr(41)))} SELECT * FROM t) GROUP BY symbol"


ORACLES = {
    "bars_daily": f"WITH {BARS} SELECT symbol, timestamp, {rs(['open', 'high', 'low', 'close', 'volume', 'quote_volume'], 4)}, trades, {r('taker_buy_quote', None, 4)} FROM bars",
    "bars_15m": f"WITH {BARS15} SELECT symbol, timestamp, {rs(['open', 'high', 'low', 'close', 'volume', 'quote_volume'], 4)}, trades, {r('taker_buy_quote', None, 4)} FROM bars15",
    "inventory": f"WITH {BARS} SELECT symbol, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM bars GROUP BY 1",
    "flow_coverage": f"SELECT l_returnflag AS symbol, count(*) AS snapshots, {r('epoch(max(l_shipdate) - min(l_shipdate)) / 86400', 'span_days')}, epoch(max(l_shipdate) - min(l_shipdate)) / 86400 >= 90 AS testable FROM lineitem GROUP BY 1",
    "inventory_summary": f"WITH {BARS}, f AS (SELECT l_returnflag, count(*) AS n, epoch(max(l_shipdate) - min(l_shipdate)) / 86400 AS d FROM lineitem GROUP BY 1) SELECT (SELECT count(DISTINCT symbol) FROM bars) AS symbols, (SELECT count(*) FROM bars) AS bars, (SELECT round(max(d), 6) FROM f) AS max_span_days, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS snapshots, (SELECT round(least(100.0::DOUBLE, max(d) / 90 * 100), 6) FROM f) AS progress_pct",
    "universe_screen": f"WITH {BARS}, l AS (SELECT symbol, count(*) AS local_bars, strftime(min(timestamp), '%Y-%m-%d') AS history_since FROM bars GROUP BY 1) SELECT k.symbol, CAST(lastPrice AS DOUBLE) AS last_price, CAST(priceChangePercent AS DOUBLE) AS change_24h_pct, CAST(quoteVolume AS DOUBLE) AS quote_volume_24h, CAST(n AS BIGINT) AS trades_24h, coalesce(local_bars, 0) AS local_bars, history_since, CAST(quoteVolume AS DOUBLE) >= 1000000 AS liquid FROM (SELECT * FROM {VALS(fx.TICKER, 'symbol, lastPrice, priceChangePercent, quoteVolume, n')}) k LEFT JOIN l USING (symbol)",
    "asof_funding": f"WITH {BARS}, {BARS15} SELECT a.symbol, a.timestamp, {r('a.close', 'close')}, {r('b.close', 'daily_close')} FROM bars15 a ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'R') b ON a.timestamp >= b.timestamp",
    "feature_frame_15m": f"WITH {BARS15}, {frame('bars15', False, False)} SELECT symbol, timestamp, {rs(['momentum_24', 'volatility_24', 'range_position', 'atr_pct'])} FROM feats",
    "regime_label": f"{BASE} SELECT symbol, timestamp, {REGIME} AS regime FROM (SELECT *, {roll('median', 'volatility_168', 720, 100)} AS m FROM feats)",
    **{k: f"{BASE} SELECT symbol, timestamp, {rs(v)} FROM feats" for k, v in {**FEATURE_GROUPS, "feature_frame": FRAME}.items()},
    **{k: f"{BASE} SELECT * FROM (SELECT '{n}' AS strategy, symbol, idx, timestamp, CAST({SIDES[n][0]} AS DOUBLE) + 0.0 AS side FROM feats) WHERE side <> 0" for k, n in {"null_always_long": "null_always_long", "null_alternating": "null_alternating", "null_random_hash": "null_random_0", "lookahead_control": "positive_control_lookahead"}.items()},
    **{k: f"{BASE} SELECT symbol, timestamp, CAST({SIDES[r_.name][0]} AS INT) AS side FROM feats" for k, r_ in RULES.items()},
    "triple_barrier_long": f"{BASE}, {trades(['every_long'])} SELECT {LABELS} FROM t",
    "triple_barrier_short": f"{BASE}, {trades(['every_short'])} SELECT {LABELS} FROM t",
    "net_events": f"{TRADES} SELECT {LABELS}, {rs(['funding_bps', 'cost_bps', 'net_return'])}, regime FROM t",
    "segments": " UNION ALL ".join(segment(k) for k in ("research", "holdout", "all")),
    "funding_paid": f"WITH {BARS}, {FUNDING} SELECT symbol, timestamp, {r('coalesce((SELECT sum(funding_rate) FROM funding g WHERE g.symbol = s.symbol AND g.timestamp > s.timestamp AND g.timestamp <= s.until), 0)', 'paid')} FROM (SELECT symbol, timestamp, lead(timestamp, 24) {O} AS until FROM bars) s WHERE until IS NOT NULL",
    "cost_breakdown": f"WITH {BARS}, {FUNDING}, {COSTS} SELECT symbol, {r('adv', None, 4)}, 10.0::DOUBLE AS fees_bps, {r('spread * 1.5::DOUBLE', 'spread_cost_bps', 4)}, {r('80 * sqrt(1000.0::DOUBLE / adv)', 'impact_bps', 4)}, {r('round_trip_bps', 'total_bps', 4)}, 'observed:' || (SELECT count(*) FROM book WHERE book.symbol = co.symbol) AS source FROM co",
    "trade_stats": f"{TRADES}, {stats('strategy')} SELECT strategy, n_trades, {rs(STAT, 5)} FROM ts",
    "trade_stats_by_regime": f"{TRADES}, {stats('strategy, regime')} SELECT strategy, regime, n_trades, {rs(STAT, 5)} FROM ts",
    "drawdown_curve": f"{BASE}, {trades(['null_alternating'])}, {stats('strategy')} SELECT strategy, symbol, entry_time, {rs(['log_equity', 'drawdown'], 5)} FROM dd",
    "cv_folds": f"{TRADES}, {FOLDS} SELECT strategy, fold, test_start, test_end, n_train, purged, embargoed, n_trades, {rs(['win_rate', 'mean_return', 'sharpe'])} FROM fo",
    "fold_consistency": f"{TRADES}, {FOLDS} SELECT strategy, {rs(['mean_sharpe', 'std_sharpe'])}, positive_folds, total_folds FROM fc",
    "sharpe_moments": f"{TRADES}, {MOMENTS} SELECT strategy, {rs(['sharpe', 'skew', 'kurtosis'])}, n_obs FROM ds",
    "dsr_z": f"{TRADES}, {MOMENTS} SELECT strategy, {rs(['sharpe_threshold', 'z'], 5)} FROM ds",
    "dsr": f"{TRADES}, {MOMENTS} SELECT strategy, {r('dsr', None, 5)} FROM ds",
    "scorecard_batch": f"{CARDS} SELECT strategy, n_trades, {rs(['mean_return', 'sharpe', 'dsr', 'mean_cost_bps', 'cost_drag_ratio'], 5)}, positive_folds, total_folds, passed, verdict FROM cards",
    "verdict_gates": f"{CARDS} SELECT strategy, passed, array_to_string(reasons, '; ') AS reasons FROM cards",
    "strategy_fitness": f"{CARDS} SELECT strategy, {r('CASE WHEN n_trades < 30 THEN 0 ELSE coalesce(dsr, 0) * greatest(sharpe, 0) * (0.5 + 0.5 * coalesce(positive_folds / nullif(total_folds, 0), 0)) END', 'fitness', 5)} FROM cards",
    "daily_returns_matrix": f"{BASE}, {trades(['null_random_0', 'null_random_1', 'null_random_2', 'null_always_long', 'null_alternating'], False).replace('adv.symbol = y.symbol', 'adv.symbol = y.symbol')} SELECT 1 AS x FROM t LIMIT 0",
    "pbo_cscv": f"{pbo(f'{BASE}, {trades(["every_long", "every_short", "long_6", "short_48"])}')} SELECT {rs(['pbo', 'median_logit'])}, (SELECT count(DISTINCT strategy) FROM fu) AS n_strategies, (SELECT count(DISTINCT day) FROM fu) AS n_periods, n_combinations FROM pb",
    "ledger_summary": f"WITH {HYP}, {TST}, {STS} SELECT count(*) AS total_hypotheses, count(*) FILTER (WHERE status = 'promoted') AS promoted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'registered') AS untested, (SELECT count(*) FROM tst) AS total_tests FROM now",
    "hypothesis_status": f"WITH {HYP}, {TST}, {STS} SELECT CAST(id AS BIGINT) AS id, title, status FROM now",
    "hypothesis_search": f"WITH {HYP} SELECT id, title, keyword FROM hyp, {VALS([(k,) for k in fx.KEYWORDS], 'keyword')} WHERE contains(lower(title), lower(keyword)) OR contains(lower(statement), lower(keyword)) OR contains(lower(economic_rationale), lower(keyword)) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY id DESC) <= 20",
    "failure_log": f"WITH {HYP}, {TST} SELECT hypothesis_id, t.id AS test_id, CAST(n_trials AS INT) AS n_trials, 'reject' AS verdict, n_trades, sharpe, first_reason, title, predicted_direction FROM (SELECT * FROM tst WHERE passed = 0 ORDER BY id DESC LIMIT 40) t JOIN hyp h ON h.id = t.hypothesis_id",
    "holdout_budget": f"WITH {HOLD} SELECT strategy_name, count(*) AS uses, max(passed) AS ever_passed, count(*) < 1 AS can_access FROM hold GROUP BY 1",
    "archive_latest": f"WITH {STRAT} SELECT CAST(id AS BIGINT) AS id, name, CAST(generation AS INT) AS generation, niche, fitness, CAST(passed AS INT) AS passed, status FROM arch",
    "elites_per_niche": f"WITH {STRAT} SELECT niche, name, fitness, rank FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY fitness DESC, id DESC) AS rank FROM arch WHERE status = 'active') WHERE rank <= 2",
    "archive_summary": f"WITH {STRAT} SELECT niche, count(*) AS n, max(fitness) AS best, (SELECT count(*) FROM arch) AS total, (SELECT count(*) FROM arch WHERE status = 'active') AS active, (SELECT count(*) FROM arch WHERE passed = 1) AS promoted, (SELECT count(DISTINCT niche) FROM arch) AS niches_occupied FROM arch GROUP BY niche",
    "niche_attribution": f"WITH {STRAT} SELECT niche, count(*) AS explored, CAST(sum(passed) AS BIGINT) AS promoted, {r('max(fitness)', 'best_fitness')}, {r('avg(sharpe)', 'mean_sharpe')}, count(*) FILTER (WHERE status LIKE 'retired%') AS retired, {r('sum(passed) / count(*)', 'promotion_rate')}, (SELECT count(*) FROM arch) AS total_explored, (SELECT CAST(sum(passed) AS BIGINT) FROM arch) AS total_promoted, {r('(SELECT sum(passed) / count(*) FROM arch)', 'total_rate')} FROM arch GROUP BY niche",
    "niche_of": f"WITH {STRAT} SELECT CAST(id AS BIGINT) AS id, niche FROM strat",
    "forecast_resolution": f"WITH {FC} SELECT id, outcome, resolution, {r('last')}, covered FROM rf",
    "agent_scores": f"WITH {FC}, {scores('agent_role, regime')}",
    "leaderboard": f"WITH {FC}, {scores('agent_role')}",
    "reliability_curve": f"WITH {FC} SELECT agent_role, CAST(CASE WHEN probability < 0.2 THEN 0 WHEN probability < 0.4 THEN 1 WHEN probability < 0.6000000000000001 THEN 2 WHEN probability < 0.8 THEN 3 ELSE 4 END AS BIGINT) AS bucket, count(*) AS n, {r('avg(probability)', 'predicted')}, {r('avg(outcome)', 'actual')} FROM fj WHERE outcome IS NOT NULL GROUP BY 1, 2",
    "forecast_summary": f"WITH {FC} SELECT count(*) AS total, count(outcome) AS resolved, count(*) - count(outcome) AS open FROM fj",
    "calibration_shrink": f"WITH {FC} SELECT id, {r('0.5 + (probability - 0.5) * 0.5', 'calibrated')} FROM fc",
    "price_stats": f"WITH {BARS}, q AS (SELECT *, close / lag(close) {O} - 1 AS ret FROM ({RECENT} FROM bars) WHERE back <= 720), g AS (SELECT symbol, max(close) FILTER (WHERE back = 1) AS last_price, {', '.join(f'max(close) FILTER (WHERE back = {k + 1}) AS c{k}' for k in (6, 24, 72, 168))}, stddev_samp(ret) AS volatility, max(high) AS high, min(low) AS low, avg(quote_volume) AS mean_quote_volume, max(quote_volume) FILTER (WHERE back = 1) AS v FROM q GROUP BY 1) SELECT symbol, (SELECT count(*) FROM bars b WHERE b.symbol = g.symbol) AS bars_available, (SELECT strftime(min(timestamp), '%Y-%m-%d') FROM bars b WHERE b.symbol = g.symbol) AS history_since, {r('last_price', None, 5)}, {', '.join(r(f'last_price / c{k} - 1', f'return_{k}b', 5) for k in (6, 24, 72, 168))}, {rs(['volatility', 'high', 'low'], 5)}, {r('(last_price - low) / nullif(high - low, 0)', 'position_in_range', 5)}, {r('mean_quote_volume', None, 5)}, {r('v / mean_quote_volume', 'volume_vs_mean', 5)} FROM g",
    "funding_profile": f"WITH {FUNDING}, f AS ({RECENT} FROM funding), l AS (SELECT symbol, funding_rate AS current FROM f WHERE back = 1) SELECT symbol, count(*) AS n, {r('current', None, 5)}, {r('current * 3 * 365 * 100', 'annualised_pct', 5)}, {r('avg(CAST(funding_rate < current AS DOUBLE)) * 100', 'percentile', 5)}, {r('avg(funding_rate) FILTER (WHERE back <= 21)', 'mean_recent', 5)}, {r('sum(funding_rate) FILTER (WHERE back <= 21)', 'sum_recent', 5)}, {r('avg(funding_rate)', 'mean_all', 5)}, {r('stddev_samp(funding_rate)', 'sd_all', 5)}, {r('(current - avg(funding_rate) FILTER (WHERE back <= 21)) / nullif(stddev_samp(funding_rate) FILTER (WHERE back <= 21), 0)', 'z_recent', 5)} FROM f JOIN l USING (symbol) GROUP BY symbol, current",
    "positioning_measures": f"WITH {BARS15}, v AS (SELECT symbol, timestamp, 'quote_volume' AS measure, quote_volume AS x FROM bars15 UNION ALL SELECT symbol, timestamp, 'volume', volume FROM bars15 UNION ALL SELECT symbol, timestamp, 'taker_buy_quote', taker_buy_quote FROM bars15), q AS (SELECT *, row_number() OVER (PARTITION BY symbol, measure ORDER BY timestamp DESC) AS k FROM v), g AS (SELECT symbol, measure, count(*) AS n, max(x) FILTER (WHERE k = 1) AS current, avg(x) AS mean, max(x) FILTER (WHERE k = 25) AS b, stddev_samp(x) AS sd FROM q WHERE k <= 168 GROUP BY 1, 2) SELECT symbol, measure, n, {rs(['current', 'mean'], 5)}, {r('(current / nullif(b, 0) - 1) * 100', 'change_24_pct', 5)}, {r('(current - mean) / nullif(sd, 0)', 'zscore', 5)} FROM g",
    "positioning_summary": f"WITH {BARS15}, q AS (SELECT * FROM ({RECENT} FROM bars15) WHERE back <= 168), g AS (SELECT symbol, count(*) AS n, max(quote_volume) FILTER (WHERE back = 1) AS current, avg(quote_volume) AS mean, max(quote_volume) FILTER (WHERE back = 25) AS b, stddev_samp(quote_volume) AS sd FROM q GROUP BY 1) SELECT symbol, n, {rs(['current', 'mean'], 5)}, {r('(current / nullif(b, 0) - 1) * 100', 'change_24_pct', 5)}, {r('(current - mean) / nullif(sd, 0)', 'zscore', 5)} FROM g",
    "order_book_walk": f"WITH {BOOKS}, a AS (SELECT symbol, i, asks[i].price AS p, asks[i].price * asks[i].qty AS usd FROM (SELECT symbol, asks, unnest(range(1, len(asks) + 1)) AS i FROM b)), c AS (SELECT *, greatest(0.0::DOUBLE, least(usd, 1000.0::DOUBLE - coalesce(sum(usd) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM a), f AS (SELECT symbol, sum(take) AS filled, sum(take * p) / nullif(sum(take), 0) AS fill, sum(usd) AS ask_usd FROM c GROUP BY 1), g AS (SELECT b.symbol, bids[1].price AS bid, asks[1].price AS ask, list_sum(list_transform(bids, lambda x: x.price * x.qty)) AS bid_usd, f.* EXCLUDE (symbol) FROM b JOIN f USING (symbol)) SELECT symbol, {r('(bid + ask) / 2', 'mid')}, {r('(ask - bid) / ((bid + ask) / 2) * 10000', 'spread_bps')}, {rs(['bid_usd', 'ask_usd'])}, {r('(bid_usd - ask_usd) / (bid_usd + ask_usd)', 'imbalance')}, filled >= 990 AS fillable, {r('(fill - ask) / ((bid + ask) / 2) * 10000', 'slippage_bps')} FROM g",
    "symbol_profile": f"{BASE}, {COSTS}, {corr('bars')}, la AS (SELECT * FROM ({RECENT} FROM feats) WHERE back = 1), d0 AS (SELECT symbol, timestamp, close / max(close) {O} - 1 AS d FROM bars), d1 AS (SELECT symbol, min(d) AS max_drawdown, arg_max(d, timestamp) AS drawdown FROM d0 GROUP BY 1) SELECT la.symbol, la.timestamp, {', '.join(r('la.' + c, c, 5) for c in ['close', 'momentum_24', 'momentum_168', 'volatility_168', 'return_zscore', 'atr_pct', 'range_position'])}, {rs(['max_drawdown', 'drawdown', 'adv', 'round_trip_bps'], 5)}, {r('(SELECT correlation FROM cp WHERE (a = la.symbol AND b = ' + chr(39) + BENCHMARK + chr(39) + ') OR (b = la.symbol AND a = ' + chr(39) + BENCHMARK + chr(39) + '))', 'benchmark_correlation', 5)} FROM la JOIN d1 USING (symbol) JOIN co USING (symbol)",
    "correlation_matrix": f"WITH {BARS15}, {corr('bars15')} SELECT a, b, {r('correlation')}, n FROM cp",
    "correlated_pairs": f"WITH {BARS}, {corr('bars')} SELECT a, b, {r('correlation')}, n, {r('(SELECT avg(correlation) FROM cp)', 'mean_correlation')}, correlation > 0.7 AS clustered, a = '{BENCHMARK}' OR b = '{BENCHMARK}' AS with_benchmark FROM cp",
    "trade_ev": f"WITH {BARS}, {FUNDING}, {COSTS}, i AS (SELECT *, CASE WHEN direction = 'long' THEN entry - stop ELSE stop - entry END AS risk, CASE WHEN direction = 'long' THEN target - entry ELSE entry - target END AS reward FROM {VALS(fx.IDEAS, 'symbol, direction, entry, stop, target, win_probability')}), j AS (SELECT *, CASE WHEN direction NOT IN ('long', 'short') THEN 'direction must be ''long'' or ''short''' WHEN NOT (win_probability > 0 AND win_probability < 1) THEN 'win_probability must be strictly between 0 and 1' WHEN risk <= 0 THEN 'stop is on the wrong side of entry for a ' || direction WHEN reward <= 0 THEN 'target is on the wrong side of entry for a ' || direction END AS error FROM i), k AS (SELECT * EXCLUDE (risk, reward), CASE WHEN error IS NULL THEN risk END AS risk, CASE WHEN error IS NULL THEN reward END AS reward FROM j), l AS (SELECT k.*, reward / risk AS r, win_probability * reward / entry - (1 - win_probability) * risk / entry AS g, round_trip_bps AS c FROM k LEFT JOIN co USING (symbol)) SELECT symbol, direction, {rs(['entry', 'stop', 'target', 'win_probability'], 5)}, error, {r('risk / entry * 100', 'risk_pct', 5)}, {r('reward / entry * 100', 'reward_pct', 5)}, {r('r', 'r_multiple', 5)}, {r('1 / (1 + r)', 'breakeven_win_rate', 5)}, {r('g * 100', 'gross_ev_pct', 5)}, {r('(g - c / 10000) * 100', 'net_ev_pct', 5)}, {r('CASE WHEN r IS NOT NULL THEN greatest(0, win_probability - (1 - win_probability) / r) * 100 END', 'full_kelly_pct', 5)}, {r('CASE WHEN r IS NOT NULL THEN least(2, greatest(0, win_probability - (1 - win_probability) / r) * 25) END', 'position_pct', 5)}, (g - c / 10000 > 0) AND r >= 2.5 AS tradeable FROM l",
    "position_size": f"WITH {BARS}, {wins('bars', 'symbol, date_trunc(' + chr(39) + 'month' + chr(39) + ', timestamp) AS month')} SELECT symbol, CAST(month AS TIMESTAMP) AS month, {rs(['p', 'payoff', 'breakeven', 'kelly'])}, {r('least(2.0::DOUBLE, kelly * 0.25::DOUBLE * 100)', 'position_pct')}, coalesce(p > breakeven, false) AND kelly > 0 AS tradeable FROM sz",
    "exposure_caps": f"WITH {BARS15}, {corr('bars15')}, {wins('bars15', 'symbol')}, id AS (SELECT symbol, least(2.0::DOUBLE, kelly * 0.25::DOUBLE * 100) AS position_pct FROM sz), ex AS (SELECT symbol, position_pct, position_pct + coalesce((SELECT sum(o.position_pct) FROM id o JOIN cp ON correlation > 0 AND ((a = i.symbol AND b = o.symbol) OR (b = i.symbol AND a = o.symbol))), 0) AS cluster_pct, (SELECT sum(position_pct) FROM id) AS total_pct FROM id i) SELECT symbol, {rs(['position_pct', 'cluster_pct', 'total_pct'])}, cluster_pct <= 5 AS within_cluster_cap, total_pct <= 10 AS within_total_cap FROM ex",
    "decay_zscore": f"WITH a AS (SELECT strategy, avg(net_return) AS m, coalesce(stddev_samp(net_return), 0) AS v FROM {part(_until)} GROUP BY 1), b AS (SELECT strategy, count(*) AS n_trades, avg(net_return) AS mean_return FROM {part(_since)} GROUP BY 1), c AS (SELECT *, (mean_return - m) / nullif(v / sqrt(n_trades), 0) AS z FROM b JOIN a USING (strategy)) SELECT strategy, n_trades, {r('mean_return', None, 5)}, {r('m', 'expected', 5)}, {r('CASE WHEN n_trades >= 5 THEN z END', 'decay_z', 5)}, CASE WHEN n_trades < 5 THEN 'insufficient' WHEN coalesce(z, 0) < -2 OR (mean_return <= 0 AND m > 0) THEN 'retire' ELSE 'healthy' END AS status FROM c",
    "meta_training_set": f"{META} SELECT symbol, entry_time, side, {rs(CTX)}, meta_label FROM me",
    "exact_auc": f"{META}, p AS (SELECT symbol, round(return_zscore, 1) AS p, meta_label AS y FROM me) SELECT symbol, {r('(SELECT avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) FROM p a JOIN p b ON a.symbol = b.symbol WHERE a.y = 1 AND b.y = 0 AND a.symbol = s.symbol)', 'auc')}, count(*) AS n_test FROM p s GROUP BY symbol",
    "lookahead_guard": f"{BASE}, g AS (SELECT *, lead(close) {O} / close - 1 AS ahead FROM feats) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'corr({c}, ahead)', 'correlation')}, abs(corr({c}, ahead)) < 0.2 AS ok FROM g" for c in GUARD),
    "event_log_tail": f"WITH {LOG} SELECT index, ts, type FROM ev WHERE index >= 100 AND type <> 'error' ORDER BY index DESC LIMIT 500",
    "event_log_page": f"WITH {LOG} SELECT index, ts, type FROM ev WHERE index >= 100 AND type <> 'error' ORDER BY index LIMIT 500",
    "feature_catalogue": f"{BASE} " + " UNION ALL ".join(f"SELECT '{n}' AS feature, '{m.replace(chr(39), 2 * chr(39))}' AS meaning, count({n}) FILTER (WHERE NOT isnan({n})) AS bars, count(DISTINCT symbol) FILTER (WHERE {n} IS NOT NULL AND NOT isnan({n})) AS symbols FROM feats" for n, m in signals.FEATURES.items()),
    "return_profile": f"WITH {BARS} SELECT symbol, {r('avg(ret)', 'mean_return')}, {r('stddev_samp(ret)', 'volatility')}, count(ret) AS n FROM (SELECT *, close / lag(close) {O} - 1 AS ret FROM bars) GROUP BY symbol",
}
_nulls = ["null_random_0", "null_random_1", "null_random_2", "null_always_long", "null_alternating"]
ORACLES["daily_returns_matrix"] = f"{BASE}, {trades(_nulls)} SELECT strategy, CAST(date_trunc('day', entry_time) AS TIMESTAMP) AS day, {r('avg(net_return)', 'r')} FROM t GROUP BY 1, 2"
_suite = [*[f"null_random_{i}" for i in range(5)], "null_always_long", "null_alternating", "positive_control_lookahead"]
_best = f"CASE WHEN strategy = 'positive_control_lookahead' THEN 0.0::DOUBLE ELSE {best_of(5)!r} END"
ORACLES["null_suite"] = f"""SELECT count(*) FILTER (WHERE strategy LIKE 'null%') AS nulls_evaluated, count(*) FILTER (WHERE strategy LIKE 'null%' AND passed) AS nulls_passed,
  coalesce(bool_or(passed) FILTER (WHERE strategy NOT LIKE 'null%'), false) AS control_passed,
  count(*) FILTER (WHERE strategy LIKE 'null%' AND passed) = 0 AND coalesce(bool_or(passed) FILTER (WHERE strategy NOT LIKE 'null%'), false) AS trustworthy, {r('any_value(p.pbo)', 'pbo')}
FROM ({cards(f"{BASE}, {trades(_suite)}", moments(_best))} SELECT strategy, passed FROM cards), ({pbo(f"{BASE}, {trades(_suite[:5])}")} SELECT pbo FROM pb) p"""
ORACLES["scorecard_nested"] = f"""SELECT c.strategy, c.verdict, c.n_trades, {r('c.sharpe', 'sharpe', 5)}, {r('c.dsr', 'dsr', 5)}, f.n_folds, f.fold_trades, g.regime, g.n_trades AS regime_trades, {r('g.mean_return', 'regime_return', 5)}, {r('g.max_drawdown', 'regime_drawdown', 5)}
FROM ({CARDS} SELECT * FROM cards) c JOIN ({TRADES}, {stats('strategy, regime')} SELECT * FROM ts) g ON c.strategy = g.strategy
  LEFT JOIN ({TRADES}, {FOLDS} SELECT strategy, count(*) AS n_folds, CAST(sum(n_trades) AS BIGINT) AS fold_trades FROM fo GROUP BY strategy) f ON f.strategy = c.strategy"""
_live = " UNION ALL ".join(f"SELECT strategy, net_return FROM ({BASE}, {trades([n], False, cut(f'feats WHERE timestamp >= TIMESTAMP {chr(39)}{at.replace(chr(84), chr(32))}{chr(39)}'))} SELECT * FROM t)" for n, at, _, _ in fx.WATCHED)
ORACLES["monitor"] = f"""WITH b AS (SELECT strategy, count(*) AS n_trades, avg(net_return) AS mean_return FROM ({_live}) GROUP BY 1
), a AS (SELECT * FROM {VALS([(n, m, v) for n, _, m, v in fx.WATCHED], 'strategy, m, v')}
), c AS (SELECT *, (mean_return - m) / nullif(v / sqrt(n_trades), 0) AS z FROM b JOIN a USING (strategy))
SELECT strategy, n_trades, {r('mean_return', None, 5)}, {r('m', 'expected', 5)}, {r('CASE WHEN n_trades >= 5 THEN z END', 'decay_z', 5)},
  CASE WHEN n_trades < 5 THEN 'insufficient' WHEN coalesce(z, 0) < -2 OR (mean_return <= 0 AND m > 0) THEN 'retire' ELSE 'healthy' END AS status FROM c"""
ORACLES["forecasts_open"] = f"WITH {FC} SELECT id, symbol, CAST(horizon_hours AS INT) AS horizon_hours FROM fc WHERE id NOT IN (SELECT id FROM rf)"
ORACLES["calibration_isotonic"] = f"""WITH {FC}, h AS (SELECT agent_role, probability AS p, avg(outcome) AS y, count(*) AS w FROM fj WHERE outcome IS NOT NULL GROUP BY 1, 2
), c AS (SELECT *, row_number() OVER o AS k, sum(w) OVER o AS sw, sum(w * y) OVER o AS sy, sum(w) OVER (PARTITION BY agent_role) AS n FROM h WINDOW o AS (PARTITION BY agent_role ORDER BY p)
), m AS (SELECT a.agent_role, a.k AS a, b.k AS b, (b.sy - a.sy + a.w * a.y) / (b.sw - a.sw + a.w) AS m FROM c a JOIN c b ON a.agent_role = b.agent_role AND a.k <= b.k
), i AS (SELECT agent_role, p, max(least_) AS v FROM (SELECT c.agent_role, c.p, m.a, min(m.m) AS least_ FROM c JOIN m ON m.agent_role = c.agent_role AND m.a <= c.k AND m.b >= c.k WHERE c.n >= 25 GROUP BY 1, 2, 3) GROUP BY 1, 2
), e AS (SELECT id, agent_role, probability AS x, max(CASE WHEN p <= probability THEN p END) AS lo, min(CASE WHEN p >= probability THEN p END) AS hi FROM fc LEFT JOIN i USING (agent_role) GROUP BY 1, 2, 3
), g AS (SELECT e.*, a.v AS y0, b.v AS y1 FROM e LEFT JOIN i a ON a.agent_role = e.agent_role AND a.p = e.lo LEFT JOIN i b ON b.agent_role = e.agent_role AND b.p = e.hi)
SELECT id, agent_role, {r('x', 'probability')}, {r('CASE WHEN y0 IS NULL AND y1 IS NULL THEN 0.5 + (x - 0.5) * 0.5 ELSE greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR hi = lo THEN y0 ELSE y0 + (x - lo) * (y1 - y0) / (hi - lo) END)) END', 'calibrated')} FROM g"""
ORACLES["event_count"] = "SELECT count(*) AS n FROM events"
ORACLES["holdout_history"] = f"WITH {HOLD} SELECT id, strategy_name, accessed_at, passed FROM hold"
ORACLES["research_state"] = f"WITH {HYP}, {TST}, {STS}, {STRAT}, {FC} SELECT (SELECT count(*) FROM now) AS total_hypotheses, (SELECT count(*) FROM now WHERE status = 'promoted') AS promoted, (SELECT count(*) FROM tst) AS total_tests, (SELECT count(*) FROM arch) AS total, (SELECT count(*) FROM arch WHERE status = 'active') AS active, (SELECT count(DISTINCT niche) FROM arch) AS niches_occupied, count(*) AS forecasts, count(*) - count(outcome) AS open, (SELECT count(*) FROM customer) AS holdout_uses FROM fj"
assert math.isfinite(best_of(TRIALS))
