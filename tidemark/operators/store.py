"""Research ledger and strategy archive: append-only Parquet logs and views of their present state.

The driver is the only writer.  What a database would update is appended again; the views
take the latest row of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.kept import Scratch

HYPOTHESES = "id bigint, created_at string, author string, title string, statement string, economic_rationale string, predicted_direction string, feature_definition string, horizon_bars int, symbols string, code_hash string"
TESTS = "id bigint, hypothesis_id bigint, created_at string, harness_version string, segment string, n_trials int, passed int, scorecard string"
HOLDOUT = "id bigint, strategy_name string, accessed_at string, passed int, scorecard string"
STRATEGIES = "id bigint, created_at string, name string, generation int, parent string, genome string, niche string, fitness double, passed int, status string, scorecard string, hypothesis_id bigint"
FORECASTS = "id bigint, created_at timestamp_ntz, agent_role string, symbol string, direction string, probability double, horizon_hours int, entry_price double, target_price double, invalidation double, regime string, thesis string"
RESOLUTIONS = "id bigint, forecast_id bigint, resolved_at string, outcome int, resolution string"
SCHEMAS = {"hypotheses": HYPOTHESES, "tests": TESTS, "holdout_access": HOLDOUT, "strategies": STRATEGIES, "forecasts": FORECASTS, "resolutions": RESOLUTIONS}


class NotPreRegistered(RuntimeError):
    """A test was recorded for a hypothesis that was never registered."""


class HoldoutExhausted(RuntimeError):
    """A strategy asked for the holdout once more than its budget allows."""


class Ledger:
    """The logs below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, name: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append_all(self, table: str, rows: list[dict]) -> list[int]:
        """The new ids of rows, all written as one file."""
        names = self.spark.createDataFrame([], SCHEMAS[table]).columns
        if unknown := {k for r in rows for k in r} - set(names):
            raise ValueError(f"{table} has no {sorted(unknown)}")
        last = self.log(table).agg(F.max("id")).first()[0] or 0
        ids = list(range(last + 1, last + 1 + len(rows)))
        if rows:
            new = [tuple({**r, "id": i}.get(c) for c in names) for i, r in zip(ids, rows, strict=True)]
            self.spark.createDataFrame(new, SCHEMAS[table]).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")
        return ids

    def append(self, table: str, /, **row) -> int:
        return self.append_all(table, [row])[0]

    def register_all(self, rows: list[dict]) -> list[int]:
        for row in rows:
            if row.get("predicted_direction") not in ("long", "short", "both"):
                raise ValueError("a prediction is long, short or both")
            if not (row.get("economic_rationale") or "").strip():
                raise ValueError("a hypothesis without a rationale is not registered")
        return self.append_all("hypotheses", rows)

    def register(self, **row) -> int:
        return self.register_all([row])[0]

    def record_tests(self, rows: list[dict]) -> list[int]:
        want = {r.get("hypothesis_id") for r in rows}
        known = {r.id for r in self.log("hypotheses").where(F.col("id").isin(list(want))).select("id").collect()}
        if missing := want - known:
            raise NotPreRegistered(f"hypotheses {sorted(map(str, missing))} are not registered")
        return self.append_all("tests", rows)

    def record_test(self, hypothesis_id: int, **row) -> int:
        return self.record_tests([{**row, "hypothesis_id": hypothesis_id}])[0]

    def trial_count(self) -> int:
        return self.log("hypotheses").count()

    def spend_holdout(self, name: str, s: Settings = DEFAULT, **row) -> int:
        if self.log("holdout_access").where(F.col("strategy_name") == name).count() >= s.holdout_budget:
            raise HoldoutExhausted(f"{name} has used its holdout budget of {s.holdout_budget}")
        return self.append("holdout_access", strategy_name=name, **row)

    def archive_all(self, rows: list[dict]) -> list[int]:
        return self.append_all("strategies", [{"status": "active", **r} for r in rows])

    def archive(self, **row) -> int:
        return self.archive_all([row])[0]

    def record_forecast(self, **row) -> int:
        from .forecasts import checked

        checked(row.get("direction"), row.get("probability"))
        return self.append("forecasts", **row)

    def resolve_forecasts(self, bars: DataFrame, now, resolved_at: str | None = None) -> int:
        """Resolve the open forecasts that are due and have bars; how many."""
        from .forecasts import resolve

        got = resolve(open_forecasts(self.log("forecasts"), self.log("resolutions")), bars, now)
        new = got.select(F.col("id").alias("forecast_id"), F.lit(resolved_at).cast("string").alias("resolved_at"), "outcome", "resolution")
        return self.append_frame("resolutions", new)

    def append_frame(self, table: str, rows: DataFrame) -> int:
        """Append rows, however many, and how many they are; ids go on from the log's last one without gaps.

        The rows are written once, counted by partition, and numbered by these few counts.
        """
        last = self.log(table).agg(F.max("id")).first()[0] or 0
        scratch = Scratch(self.spark, "append")
        kept = scratch.keep(rows.withColumn("at_", F.monotonically_increasing_id()))
        sizes = kept.groupBy(F.shiftright("at_", 33).alias("part_")).agg(F.count("*").alias("n_"))
        before = sizes.select("part_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
        made = kept.withColumn("part_", F.shiftright("at_", 33)).join(F.broadcast(before), "part_")
        made = made.withColumn("id", F.lit(last + 1) + F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1))
        shape = self.spark.createDataFrame([], SCHEMAS[table]).schema
        n = kept.count()
        if n:
            made.select(*[F.col(f.name).cast(f.dataType) for f in shape]).write.mode("append").parquet(f"{self.root}/{table}")
        scratch.drop()
        return n

    def retire(self, name: str, reason: str) -> None:
        last = archive_latest(self.log("strategies")).where(F.col("name") == name).first()
        if last is not None:
            self.append("strategies", **{**last.asDict(), "status": f"retired:{reason}"} | {"id": None})


def forecasts_now(forecasts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """forecasts with outcome and resolution, null while open."""
    last = resolutions.groupBy(F.col("forecast_id").alias("id")).agg(F.max_by("outcome", "id").alias("outcome"), F.max_by("resolution", "id").alias("resolution"))
    return forecasts.join(last, "id", "left")


def open_forecasts(forecasts: DataFrame, resolutions: DataFrame) -> DataFrame:
    return forecasts.join(resolutions.select(F.col("forecast_id").alias("id")), "id", "left_anti")


def forecast_summary(now: DataFrame) -> DataFrame:
    """One row of forecasts with outcomes: total, resolved, open."""
    out = now.agg(F.count("*").alias("total"), F.count("outcome").alias("resolved"))
    return out.withColumn("open", F.col("total") - F.col("resolved"))


def hypotheses_now(hypotheses: DataFrame, tests: DataFrame) -> DataFrame:
    """hypotheses with status: that of the last test (promoted or rejected), or registered."""
    last = tests.groupBy(F.col("hypothesis_id").alias("id")).agg(F.max_by("passed", "id").alias("last"))
    status = F.when(F.col("last").isNull(), "registered").when(F.col("last") == 1, "promoted").otherwise("rejected")
    return hypotheses.join(last, "id", "left").withColumn("status", status).drop("last")


def ledger_summary(hypotheses: DataFrame, tests: DataFrame) -> DataFrame:
    h = hypotheses_now(hypotheses, tests).agg(F.count("*").alias("total_hypotheses"), F.count(F.when(F.col("status") == "promoted", 1)).alias("promoted"), F.count(F.when(F.col("status") == "rejected", 1)).alias("rejected"))
    h = h.withColumn("untested", F.col("total_hypotheses") - F.col("promoted") - F.col("rejected"))
    return h.join(tests.agg(F.count("*").alias("total_tests")), how="cross")


def search(hypotheses: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Hypotheses whose title, statement or rationale has the keyword, whatever its case; the newest first."""
    word = keyword.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = F.lit(False)
    for c in ("title", "statement", "economic_rationale"):
        hit = hit | F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False))
    return hypotheses.where(hit).orderBy(F.desc("id")).limit(limit)


def failure_log(hypotheses: DataFrame, tests: DataFrame, limit: int = 40) -> DataFrame:
    """The last failed tests, with what their scorecards say."""
    t, get = tests.where("passed = 0").orderBy(F.desc("id")).limit(limit), lambda p: F.get_json_object("scorecard", p)
    t = t.select(F.col("id").alias("test_id"), "hypothesis_id", "n_trials", get("$.verdict").alias("verdict"), get("$.overall.n_trades").cast("bigint").alias("n_trades"), get("$.overall.sharpe").cast("double").alias("sharpe"), get("$.rejection_reasons[0]").alias("first_reason"))
    return t.join(hypotheses.select(F.col("id").alias("hypothesis_id"), "title", "predicted_direction"), "hypothesis_id")


def holdout_budget(access: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return access.groupBy("strategy_name").agg(F.count("*").alias("uses"), F.max("passed").alias("ever_passed")).withColumn("can_access", F.col("uses") < s.holdout_budget)


def holdout_history(access: DataFrame) -> DataFrame:
    """Every use of the holdout, the latest first."""
    return access.select("id", "strategy_name", "accessed_at", "passed").orderBy(F.desc("id"))


def research_state(hypotheses: DataFrame, tests: DataFrame, strategies: DataFrame, forecasts: DataFrame, access: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """One row: ledger, archive, forecasts, holdout and limits as structs."""
    a = archive_latest(strategies).agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "active", 1)).alias("active"), F.count(F.when(F.col("passed") == 1, 1)).alias("promoted"), F.count_distinct("niche").alias("niches_occupied"))
    spent = access.agg(F.count("*").alias("uses"), F.count_distinct("strategy_name").alias("strategies"))
    out = None
    for name, one in (("ledger", ledger_summary(hypotheses, tests)), ("archive", a), ("forecasts", forecast_summary(forecasts)), ("holdout", spent)):
        one = one.select(F.struct(*one.columns).alias(name))
        out = one if out is None else out.join(one, how="cross")  # one row each
    limits = {"max_position_pct": s.max_position_pct, "max_total_pct": s.max_total_pct, "max_cluster_pct": s.max_cluster_pct, "min_r_multiple": s.min_r_multiple, "holdout_days": float(s.holdout_days), "holdout_budget": float(s.holdout_budget)}
    return out.withColumns({"limits": F.struct(*[F.lit(v).alias(k) for k, v in limits.items()]), "version": F.lit(s.version)})


def archive_latest(strategies: DataFrame) -> DataFrame:
    """The latest row of each name."""
    r = F.row_number().over(W.partitionBy("name").orderBy(F.desc("id")))
    return strategies.withColumn("r_", r).where("r_ = 1").drop("r_")


def elites(strategies: DataFrame, per_niche: int = 3) -> DataFrame:
    """The fittest active strategies of each niche."""
    r = F.row_number().over(W.partitionBy("niche").orderBy(F.desc("fitness"), F.desc("id")))
    return archive_latest(strategies).where("status = 'active'").withColumn("rank", r).where(F.col("rank") <= per_niche)


def archive_summary(strategies: DataFrame) -> DataFrame:
    """One row for each niche, and the totals on each."""
    a = archive_latest(strategies)
    total = a.agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "active", 1)).alias("active"), F.count(F.when(F.col("passed") == 1, 1)).alias("promoted"), F.count_distinct("niche").alias("niches_occupied"))
    return a.groupBy("niche").agg(F.count("*").alias("n"), F.max("fitness").alias("best")).join(total, how="cross")


def niche_attribution(strategies: DataFrame) -> DataFrame:
    """Per niche: how many were explored, promoted and retired, and how good they were; and the same of all niches."""
    retired = F.startswith("status", F.lit("retired"))
    mean = F.avg(F.get_json_object("scorecard", "$.overall.sharpe").cast("double"))
    g = archive_latest(strategies).groupBy("niche").agg(F.count("*").alias("explored"), F.sum("passed").alias("promoted"), F.max("fitness").alias("best_fitness"), mean.alias("mean_sharpe"), F.count(F.when(retired, 1)).alias("retired"))
    total = g.agg(F.sum("explored").alias("total_explored"), F.sum("promoted").alias("total_promoted"))
    return g.withColumn("promotion_rate", F.col("promoted") / F.col("explored")).join(total.withColumn("total_rate", F.col("total_promoted") / F.col("total_explored")), how="cross")


def niche(genomes: DataFrame) -> DataFrame:
    """genomes (genome JSON) with niche: holding period | what drives it | direction."""
    g = F.from_json("genome", "direction string, horizon int, conditions array<struct<feature:string>>")
    kinds = F.transform(g["conditions"], lambda c: F.split(c["feature"], "_")[0])
    has = lambda *names: F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names]))
    holding = F.when(g["horizon"] <= 12, "intraday").when(g["horizon"] <= 48, "swing").otherwise("position")
    driver = F.when(has("funding"), "funding").when(has("taker", "quote"), "flow").when(has("beta", "residual"), "relative").when(has("volatility", "atr"), "volatility").otherwise("price")
    return genomes.withColumn("niche", F.concat_ws("|", holding, driver, g["direction"]))
