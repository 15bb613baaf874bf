"""Search over rules: register, evaluate a generation in one Spark job, archive, breed; watch what was kept."""

from __future__ import annotations

import json
import random
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.kept import written
from .evaluate import decay, fitness, scorecards
from .signals import Rule, blend, compiled, feature_scale, fresh_rule, neighbour
from .statistics import trade_statistics
from .store import Ledger, archive_latest, niche
from .trades import trades

NO_TRADES = {"n_trades": 0, "passed": False, "verdict": "no_trades", "fitness": 0.0, "rejection_reasons": []}


def evaluate_rules(rules: list[Rule], frame: DataFrame, ledger: Ledger, funding=None, book=None, s: Settings = DEFAULT, author: str = "evolution", generation: int = 0, parents: dict[str, str] | None = None) -> list[dict]:
    """Register all rules, then score them in one plan and archive them; the scorecard of each, the fittest first.

    Registration comes first and counts whatever the outcome, so that the number of trials
    that deflates a score can't be understated.  Each log gets one file for all rules.
    """
    now = datetime.now(UTC).isoformat()
    ids = ledger.register_all([{"created_at": now, "author": author, "title": r.name, "statement": r.describe(), "economic_rationale": r.rationale or "not stated", "predicted_direction": r.direction, "feature_definition": r.genome(), "horizon_bars": r.horizon, "code_hash": r.code_hash()} for r in rules])
    trials = ledger.trial_count()
    t = trades(frame, [compiled(r) for r in rules], funding, book, s)
    got = {c.strategy: c.asDict() for c in fitness(scorecards(t, trials, s), s).collect()}  # one row a rule
    niches = {r.name: r.niche for r in niche(frame.sparkSession.createDataFrame([(r.name, r.genome()) for r in rules], "name string, genome string")).collect()}
    out, tests, kept = [], [], []
    for i, r in zip(ids, rules, strict=True):
        c = {**NO_TRADES, **got.get(r.name, {})}
        card = json.dumps({"verdict": c["verdict"], "passed": c["passed"], "rejection_reasons": list(c["rejection_reasons"]), "overall": {k: c.get(k) for k in ("n_trades", "mean_return", "sharpe", "volatility")}, "deflated": {"dsr": c.get("dsr")}}, default=str)
        tests.append({"hypothesis_id": i, "created_at": now, "harness_version": s.version, "segment": "research", "n_trials": trials, "passed": int(c["passed"]), "scorecard": card})
        kept.append({"created_at": now, "name": r.name, "generation": generation, "parent": (parents or {}).get(r.name), "genome": r.genome(), "niche": niches[r.name], "fitness": float(c["fitness"]), "passed": int(c["passed"]), "scorecard": card, "hypothesis_id": i})
        out.append({**c, "name": r.name, "fitness": float(c["fitness"]), "n_trials": trials})
    ledger.record_tests(tests)
    ledger.archive_all(kept)
    return sorted(out, key=lambda x: (-x["fitness"], x["name"]))


def tested(genome: str, frame: DataFrame, ledger: Ledger, rationale: str = "", funding=None, book=None, s: Settings = DEFAULT) -> dict:
    """The flat scorecard of a rule given as JSON, or {"error": ...} for one that is not valid or gives no reason.

    Nothing is registered for an error; all else is, whatever comes of it.
    """
    try:
        d = json.loads(genome)
        r = Rule.parse({**d, "rationale": d.get("rationale") or rationale})
    except json.JSONDecodeError as e:
        return {"error": f"not JSON: {e}"}
    except (AttributeError, KeyError, TypeError, ValueError) as e:
        return {"error": f"not a rule: {e}"}
    if not r.rationale.strip():
        return {"error": "a rule needs a rationale before it is tested"}
    c = evaluate_rules([r], frame, ledger, funding, book, s, "agent")[0]
    names = ("verdict", "passed", "rejection_reasons", "n_trades", "win_rate", "mean_return", "sharpe", "profit_factor", "max_drawdown", "dsr", "sharpe_threshold", "n_trials", "positive_folds", "total_folds", "mean_cost_bps", "cost_drag_ratio", "fitness")
    return {"strategy": r.name, "rule": r.describe(), **{k: c.get(k) for k in names}}


def evolve(frame: DataFrame, ledger: Ledger, generations: int = 2, population: int | None = None, seed: int = 7, seeds: list[Rule] | None = None, funding=None, book=None, s: Settings = DEFAULT) -> list[dict]:
    """generation, evaluated, best_name and best_fitness of each generation.

    Children come from rules drawn by rank: the r-th of n has a weight of n - r; one in four
    is a blend of two, the others a neighbour of one.
    """
    rng, size = random.Random(seed), population or s.population
    frame = written(frame)
    scale = feature_scale(frame)
    rules, history, parents = list(seeds or [fresh_rule(rng, scale) for _ in range(size)]), [], {}
    for g in range(generations):
        ranked = evaluate_rules(rules, frame, ledger, funding, book, s, f"evolution_gen{g}", g, parents)
        history.append({"generation": g, "evaluated": len(ranked), "best_name": ranked[0]["name"], "best_fitness": ranked[0]["fitness"]})
        by = {r.name: r for r in rules}
        pool, weights = [by[x["name"]] for x in ranked], [len(ranked) - k for k in range(len(ranked))]
        rules, parents = [], {}
        while len(rules) < size:
            a, b = rng.choices(pool, weights, k=2)
            child = blend(a, b, rng) if a != b and rng.random() < 0.25 else neighbour(a, rng, scale)
            if child.name not in parents:
                rules.append(child)
                parents[child.name] = a.name
    return history


def monitored(frame: DataFrame, archive: DataFrame, funding=None, book=None, s: Settings = DEFAULT) -> DataFrame:
    """Active archived strategies on the bars since their discovery, against their backtests (see decay()).

    One plan for all, and no bar is copied: a strategy counts bars from its discovery on.  Rules
    are read to the driver, as many as are active.
    """
    rows = archive.where("status = 'active'").select("name", "created_at", "genome").collect()
    if not rows:
        return frame.sparkSession.createDataFrame([], "strategy string, n_trades bigint, mean_return double, expected double, decay_z double, status string")
    t = trades(frame, [replace(compiled(Rule.parse(r.genome)), name=r.name, since=r.created_at) for r in rows], funding, book, s)
    get = lambda k: F.get_json_object("scorecard", f"$.overall.{k}").cast("double").alias(k)
    return decay(trade_statistics(t, ["strategy"]), archive.select(F.col("name").alias("strategy"), get("mean_return"), get("volatility")), s)


def retire_decayed(ledger: Ledger, frame: DataFrame, funding=None, book=None, s: Settings = DEFAULT) -> list[str]:
    """Retire the active strategies that monitored() says to; their names."""
    archive = archive_latest(ledger.log("strategies"))
    d = monitored(frame, archive, funding, book, s).where("status = 'retire'")
    flipped = (F.col("mean_return") <= 0) & (F.col("expected") > 0)
    verdicts = {r.strategy: r.why for r in d.select("strategy", F.when(flipped, "sign_flip").otherwise("decay").alias("why")).collect()}
    rows = [r.asDict() for r in archive.where(F.col("name").isin(list(verdicts))).collect()]
    ledger.archive_all([{**r, "id": None, "status": f"retired:{verdicts[r['name']]}"} for r in rows])
    return sorted(verdicts)
