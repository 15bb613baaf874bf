import json

from pyspark.sql import functions as F
from test_engine import BARS, made_bars

from tidemark.__main__ import run
from tidemark.operators.store import Ledger
from tidemark.sources import reports, tables


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path)
    tables.save_bars(spark.createDataFrame(made_bars(900, "AB"), BARS), root, "1h")
    spark.sql("SELECT explode(array('A', 'B')) AS symbol, timestamp_ntz'2024-01-01' AS timestamp, 0.0001D AS funding_rate").write.partitionBy("symbol").parquet(f"{root}/funding")
    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    common = ["--root", root, "--benchmark", "A"]
    code = run(spark, ["validate", *common, "--n-random", "3"])
    out = said()
    assert code == (0 if out[-1]["trustworthy"] else 1) and out[-1]["control_passed"] and len(out) >= 6
    assert run(spark, ["evolve", *common, "--generations", "1", "--population", "2"]) == 0
    assert said()[0]["evaluated"] == 2
    assert run(spark, ["monitor", *common, "--auto-retire"]) == 0
    out = said()
    assert isinstance([x for x in out if "retired" in x and "niche" not in x][0]["retired"], list) and sum(x["explored"] for x in out if "niche" in x) == 2
    Ledger(spark, f"{root}/ledger").record_forecast(created_at=spark.sql("SELECT timestamp_ntz'2024-01-02'").first()[0], agent_role="a", symbol="B", direction="long", probability=0.5, horizon_hours=5, entry_price=100.0, target_price=1e9, invalidation=0.0)
    assert run(spark, ["resolve", *common]) == 0
    out = said()
    assert out[0] == {"resolved": 1} and out[1]["agent_role"] == "a" and out[1]["n"] == 1
    assert run(spark, ["status", *common]) == 0
    state = said()
    assert [x["symbol"] for x in state[:2]] == ["A", "B"] and state[-1]["ledger"]["total_hypotheses"] == 2 and state[-1]["forecasts"]["open"] == 0


def test_reports(spark, tmp_path):
    root = str(tmp_path / "reports")
    ideas = spark.createDataFrame([("A", "long", 1.0, 0.9, 1.5, 0.2, 1.0), ("B", "short", 2.0, 2.2, 1.0, 0.9, 2.0)], "symbol string, direction string, entry double, stop double, target double, net_ev_pct double, position_pct double")
    assert reports.names(spark, root) == []
    for name in ("2024-01-01", "2024-01-02"):
        reports.save(ideas, root, name, "Ideas")
    assert reports.names(spark, root) == ["2024-01-02", "2024-01-01"]
    text = reports.read(spark, root, "2024-01-01").split("\n")
    assert text[0] == "# Ideas" and text[2].startswith("- B short") and text[3].startswith("- A long")
    assert spark.read.json(f"{root}/2024-01-01.json").where(F.col("symbol") == "A").count() == 1
    for bad in ("../x", "a/b", ""):
        try:
            reports.read(spark, root, bad)
        except ValueError:
            continue
        raise AssertionError(bad)
