"""Queries over the logs that are derived from the given tables, held against their SQL; and odd rows of what they use."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import market
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
STORE = "ledger_summary hypothesis_status hypothesis_search failure_log holdout_budget holdout_history archive_latest elites_per_niche archive_summary niche_attribution niche_of order_book_walk position_size exposure_caps event_log_tail event_log_page event_count".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", STORE)
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("part", "events", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert rows and sorted(rows, key=repr) == sorted(want, key=repr)


def test_wins_of_series_without_a_loss_or_a_move(spark):
    rows = [("up", 1, 10.0), ("up", 2, 11.0), ("up", 3, 12.1), ("flat", 1, 5.0), ("flat", 2, 5.0), ("one", 1, 5.0), ("mixed", 1, 10.0), ("mixed", 2, 12.0), ("mixed", 3, 10.8)]
    got = {r.symbol: (r.p, r.payoff) for r in market.win_profile(spark.createDataFrame(rows, "symbol string, timestamp int, close double")).collect()}
    assert got["up"] == (1.0, None) and got["flat"] == (0.0, None) and "one" not in got
    assert got["mixed"][0] == 0.5 and got["mixed"][1] == pytest.approx(2.0)


def test_wins_of_an_empty_table(spark):
    assert market.win_profile(spark.createDataFrame([], "symbol string, timestamp int, close double").withColumn("extra", F.lit(1))).count() == 0
