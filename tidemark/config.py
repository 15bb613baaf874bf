"""Parameters of the engine, as one frozen value that callers may replace."""

from dataclasses import dataclass


# Symbols, fees and limits that results depend on.
@dataclass(frozen=True)
class Settings:
    version: str = "1.0.0"
    # universe
    watchlist: tuple[str, ...] = ("DOGEUSDT", "SHIBUSDT", "PEPEUSDT", "WIFUSDT", "BONKUSDT", "FLOKIUSDT", "PENGUUSDT", "BOMEUSDT", "NEIROUSDT", "TURBOUSDT", "PNUTUSDT", "ACTUSDT", "TRUMPUSDT")
    benchmark: str = "BTCUSDT"
    intervals: tuple[str, ...] = ("1h", "4h", "1d")
    # costs, in basis points
    taker_fee_bps: float = 5.0
    spread_multiplier: float = 1.5
    impact_coefficient_bps: float = 40.0
    cost_floor_bps: float = 15.0
    fallback_spread_bps: float = 8.0
    notional: float = 1000.0
    # risk limits
    max_position_pct: float = 2.0
    max_total_pct: float = 10.0
    max_cluster_pct: float = 5.0
    cluster_correlation: float = 0.7
    min_r_multiple: float = 2.5
    kelly_share: float = 0.25
    # evaluation
    splits: int = 6
    embargo: float = 0.01
    horizon: int = 24
    pt_atr: float = 2.0
    sl_atr: float = 1.0
    min_trades: int = 30
    min_bars: int = 100
    min_segment_bars: int = 200
    holdout_days: int = 90
    holdout_budget: int = 1
    bars_per_day: int = 24
    adv_bars: int = 720
    # research loop
    elites: int = 3
    population: int = 8
    decay_window: int = 40
    decay_z: float = -2.0
    min_forecasts: int = 25
    flow_days: int = 90


DEFAULT = Settings()
