"""Command line over stored series: python -m tidemark validate|evolve|monitor|resolve|status --root FOLDER."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions.kept import scope
from .operators.evaluate import null_suite
from .operators.evolution import evolve, monitored, retire_decayed
from .operators.features import feature_frame
from .operators.signals import SEEDS
from .operators.forecasts import agent_scores
from .operators.store import Ledger, archive_latest, forecasts_now, niche_attribution, research_state
from .sources.tables import inventory, load_bars, load_funding


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    out.add_argument("command", choices=("validate", "evolve", "monitor", "resolve", "status"))
    out.add_argument("--root", required=True, help="folder of bars, funding and ledger")
    out.add_argument("--interval", default=DEFAULT.intervals[0])
    out.add_argument("--symbols", nargs="*")
    out.add_argument("--benchmark", default=DEFAULT.benchmark)
    out.add_argument("--n-random", type=int, default=5)
    out.add_argument("--generations", type=int, default=2)
    out.add_argument("--population", type=int, default=DEFAULT.population)
    out.add_argument("--seed", type=int, default=7)
    out.add_argument("--seeded", action="store_true", help="let the first generation be the fixed rules, not random ones")
    out.add_argument("--auto-retire", action="store_true")
    out.add_argument("--now", help="time up to which forecasts are due; by default the last bar's")
    return out


def run(spark: SparkSession, argv: list[str]) -> int:
    """Print the command's result as lines of JSON; 0, or 1 if the evaluation can't be trusted."""
    with scope():
        return _run(spark, argv)


def _run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    say = lambda rows: [print(json.dumps(r.asDict(True) if hasattr(r, "asDict") else r, default=str)) for r in rows]
    ledger = Ledger(spark, f"{a.root}/ledger")
    bars = load_bars(spark, a.root, a.interval, a.symbols and [*a.symbols, a.benchmark])
    if a.command == "status":
        say(inventory(bars).orderBy("symbol").collect())  # a row for each symbol
        now = forecasts_now(ledger.log("forecasts"), ledger.log("resolutions"))
        say(research_state(ledger.log("hypotheses"), ledger.log("tests"), ledger.log("strategies"), now, ledger.log("holdout_access")).collect())
        return 0
    if a.command == "resolve":
        until = F.lit(a.now).cast("timestamp_ntz") if a.now else F.lit(bars.agg(F.max("timestamp")).first()[0])
        say([{"resolved": ledger.resolve_forecasts(bars, until)}])
        say(agent_scores(forecasts_now(ledger.log("forecasts"), ledger.log("resolutions"))).orderBy(F.desc("skill_score")).collect())  # a row for each agent
        return 0
    funding = load_funding(spark, a.root, a.symbols)
    frame = feature_frame(bars, funding, a.benchmark)
    if a.command == "validate":
        cards, verdict = null_suite(frame, funding, n_random=a.n_random)
        say(cards.select("strategy", "n_trades", "sharpe", "dsr", "verdict").orderBy("strategy").collect())
        say(rows := verdict.collect())
        return 0 if rows[0].trustworthy else 1
    if a.command == "evolve":
        say(evolve(frame, ledger, a.generations, a.population, a.seed, list(SEEDS) if a.seeded else None, funding))
        return 0
    say(monitored(frame, archive_latest(ledger.log("strategies")), funding).collect())
    say([{"retired": retire_decayed(ledger, frame, funding)}] if a.auto_retire else [])
    say(niche_attribution(archive_latest(ledger.log("strategies"))).orderBy("niche").collect())  # a row for each niche
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("tidemark").getOrCreate(), sys.argv[1:]))
