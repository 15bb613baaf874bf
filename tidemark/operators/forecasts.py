"""Probabilistic forecasts: resolution on bars, skill of agents, calibration."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

#: Edges of the five buckets of the reliability curve.
EDGES = (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)


def checked(direction: str, probability: float) -> None:
    if direction not in ("long", "short"):
        raise ValueError("a forecast is long or short")
    if not 0 < probability < 1:
        raise ValueError("a probability lies strictly between 0 and 1")


def resolve(forecasts: DataFrame, bars: DataFrame, now) -> DataFrame:
    """id, outcome and resolution of each forecast whose deadline has passed and that has bars in (created, deadline].

    The first bar that meets either barrier decides, the invalidation before the target; without
    one the last close does.  covered says whether the bars reach the deadline.
    """
    deadline = F.col("created_at") + F.make_dt_interval(F.lit(0), F.col("horizon_hours"))
    f = forecasts.withColumn("deadline", deadline).where(F.col("deadline") <= F.lit(now))
    f = f.withColumn("day", F.explode(F.sequence(F.date_trunc("day", "created_at").cast("date"), F.date_trunc("day", "deadline").cast("date"))))
    b = bars.select("symbol", "timestamp", "high", "low", "close", F.col("timestamp").cast("date").alias("day"))
    j = f.join(b, ["symbol", "day"]).where((F.col("timestamp") > F.col("created_at")) & (F.col("timestamp") <= F.col("deadline")))
    long = F.col("direction") == "long"
    stopped = F.when(long, F.col("low") <= F.col("invalidation")).otherwise(F.col("high") >= F.col("invalidation"))
    reached = F.when(long, F.col("high") >= F.col("target_price")).otherwise(F.col("low") <= F.col("target_price"))
    hit = F.when(stopped, 0).when(reached, 1)
    g = j.groupBy("id", "entry_price", "direction", "deadline").agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("timestamp"))).alias("hit"), F.max_by("close", "timestamp").alias("last"), F.max("timestamp").alias("seen"))
    gain = F.when(F.col("direction") == "long", F.col("last") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("last"))
    note = F.when(F.col("hit") == 0, "invalidation hit first").when(F.col("hit") == 1, "target hit first").otherwise("horizon expiry")
    return g.select("id", F.coalesce("hit", F.when(gain > 0, 1).otherwise(0)).alias("outcome"), note.alias("resolution"), "last", (F.col("seen") >= F.col("deadline")).alias("covered"))


def agent_scores(resolved: DataFrame, keys: tuple[str, ...] = ("agent_role",), s: Settings = DEFAULT) -> DataFrame:
    """Brier score, skill over the base rate, log loss and standing of each agent (or agent and regime)."""
    p, y, eps = F.col("probability"), F.col("outcome").cast("double"), 1e-12
    r = resolved.where(y.isNotNull())
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg(p).alias("mean_probability"), F.avg((p - y) * (p - y)).alias("brier"), (-F.avg(y * F.ln(p + eps) + (1 - y) * F.ln(1 - p + eps))).alias("log_loss"))
    base = F.col("base_rate") * (1 - F.col("base_rate"))
    g = g.withColumns({"brier_base_rate": base, "overconfidence": F.col("mean_probability") - F.col("base_rate"), "skill_score": F.when(base > 0, 1 - F.col("brier") / F.nullif(base, F.lit(0.0))).otherwise(0.0)})
    many = F.col("n") >= s.min_forecasts
    return g.withColumn("status", F.when(many & (F.col("skill_score") > 0), "voting").when(many, "demoted").otherwise("provisional"))


def bucket(p: Column) -> Column:
    out = F.lit(len(EDGES) - 2)
    for i in range(len(EDGES) - 3, -1, -1):
        out = F.when(p < EDGES[i + 1], i).otherwise(out)
    return out


def reliability(resolved: DataFrame) -> DataFrame:
    """Per agent and bucket of stated probability: how many, what was predicted, what happened."""
    r = resolved.where(F.col("outcome").isNotNull()).withColumn("bucket", bucket(F.col("probability")))
    return r.groupBy("agent_role", "bucket").agg(F.count("*").alias("n"), F.avg("probability").alias("predicted"), F.avg(F.col("outcome").cast("double")).alias("actual"))


def shrunk(p: Column) -> Column:
    """Half way to 0.5: what an agent without a record is worth."""
    return 0.5 + (p - 0.5) * 0.5


def isotonic_maps(resolved: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(agent_role, xs, ys): the knots of each agent's isotonic map from stated to realised probability.

    Outcomes meet as counts of each stated probability; adjacent violators are then pooled agent
    by agent, each a task's group of at most as many rows as the agent has distinct probabilities.
    Agents with few forecasts have no row.
    """
    counts = resolved.where(F.col("outcome").isNotNull()).groupBy("agent_role", F.col("probability").alias("p")).agg(F.avg(F.col("outcome").cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    many = F.sum("w").over(W.partitionBy("agent_role")) >= s.min_forecasts

    def pooled(t: pa.Table) -> pa.Table:
        pools: list[list[float]] = []  # first x, last x, mean, weight
        t = t.sort_by("p")
        for p, y, w in zip(*(t.column(c).to_pylist() for c in ("p", "y", "w")), strict=True):
            pools.append([p, p, y, w])
            while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
                _, hi, m, n = pools.pop()
                a = pools[-1]
                pools[-1] = [a[0], hi, (a[2] * a[3] + m * n) / (a[3] + n), a[3] + n]
        xs = [x for a in pools for x in dict.fromkeys(a[:2])]
        ys = [a[2] for a in pools for _ in dict.fromkeys(a[:2])]
        return pa.table({"agent_role": t.column("agent_role").slice(0, 1), "xs": pa.array([xs], pa.list_(pa.float64())), "ys": pa.array([ys], pa.list_(pa.float64()))})

    return counts.withColumn("many", many).where("many").drop("many").groupBy("agent_role").applyInArrow(pooled, "agent_role string, xs array<double>, ys array<double>")


def interpolated(p: Column, xs: Column, ys: Column) -> Column:
    """The value at p of the line through (xs, ys), level beyond its ends and within 0.01 to 0.99."""
    n = F.size(xs)
    k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(xs, lambda x: x <= p))))
    at = lambda c, i: F.try_element_at(c, i.cast("int"))
    x0, x1, y0, y1 = at(xs, k), at(xs, k + 1), at(ys, k), at(ys, k + 1)
    inside = y0 + (p - x0) * ((y1 - y0) / F.nullif(x1 - x0, F.lit(0.0)))
    out = F.when(p <= at(xs, F.lit(1)), at(ys, F.lit(1))).when(p >= at(xs, n), at(ys, n)).otherwise(inside)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), out))


def calibrated(forecasts: DataFrame, resolved: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """forecasts with calibrated: mapped by each agent's record, or shrunk without one."""
    j = forecasts.join(isotonic_maps(resolved, s), "agent_role", "left")
    p = F.col("probability")
    return j.withColumn("calibrated", F.when(F.col("xs").isNull(), shrunk(p)).otherwise(interpolated(p, F.col("xs"), F.col("ys")))).select(*forecasts.columns, "calibrated")
