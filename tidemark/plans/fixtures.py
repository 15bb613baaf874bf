"""Parameters of queries that their SQL shares: tickers, ideas, thresholds and watched strategies."""

#: Words to search hypotheses for; two hold characters that mean more in a pattern.
KEYWORDS = ("RING", "brand#2", "d_w", "17%", "no such thing")
IDEAS = [("A", "long", 100.0, 95.0, 115.0, 0.4), ("N", "short", 100.0, 104.0, 88.0, 0.375), ("R", "long", 100.0, 90.0, 120.0, 0.25), ("A", "long", 100.0, 105.0, 115.0, 0.5), ("N", "short", 100.0, 104.0, 101.0, 0.5), ("R", "up", 100.0, 90.0, 120.0, 0.5), ("R", "long", 100.0, 90.0, 120.0, 1.0)]
TICKER = [("A", "101.5", "2.5", "5000000", 1200), ("N", "99.25", "-1.5", "800000", 300), ("R", "105", "0", "2000000", 700), ("X", "1.25", "12", "9000000", 50)]

#: Thresholds at which rules that this data never meets fire, in the order of their conditions.
SCALED = {"timeseries_momentum_weekly": (0.05, 0.1), "volume_breakout_confirmed": (0.5, 0.1, 0.5), "exhaustion_after_parabolic": (1.0, 0.5, 0.25), "low_vol_compression_long": (0.08, 0.5), "btc_beta_laggard": (-0.02, 0.0625)}
#: Strategies to watch: rule, time of discovery, mean return and volatility of the backtest.
WATCHED = [("smoke_meanrev", "1995-01-01T00:00:00", 0.25, 0.5), ("idiosyncratic_reversal", "1995-01-01T00:00:00", -0.25, 0.5), ("btc_beta_laggard_scaled", "1996-06-01T00:00:00", 0.015625, 0.25), ("funding_carry_crowded_short", "1996-06-01T00:00:00", 0.5, 0.0625)]


def values(rows, columns: str) -> str:
    """The rows as an SQL VALUES list with named columns."""

    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"
