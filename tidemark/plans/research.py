"""Logs of research that Spark derives from the given tables: a hypothesis is a part, its tests are
events, strategies are the orders of a customer, and a book is an order with its line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..sources import eventlog
from ..sources.tables import table

#: What a strategy holds for and looks at, dealt by its order's key.
HORIZONS = (6, 12, 24, 48, 72, 168)
LOOKS = (("funding_z",), ("quote_volume_z", "momentum_6"), ("beta_168",), ("atr_pct",), ("momentum_24", "range_position"))


def _shaped(df: DataFrame, name: str) -> DataFrame:
    shape = df.sparkSession.createDataFrame([], store.SCHEMAS[name]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def _dealt(choices, at) -> F.Column:
    return F.element_at(F.array(*choices), (at % len(choices) + 1).cast("int"))


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """A hypothesis for each part."""
    c = F.col
    return _shaped(table(spark, sf, "part").select(
        (c("p_partkey") + 1).alias("id"), _dealt([F.lit("evolution"), F.lit("analyst")], c("p_size")).alias("author"), F.concat_ws(" ", "p_name", c("p_size").cast("string")).alias("title"),
        F.concat(F.translate("p_name", " ", "_"), F.lit(" pays "), c("p_size").cast("string"), F.lit("%")).alias("statement"), F.concat_ws(" of ", "p_type", "p_brand").alias("economic_rationale"),
        _dealt([F.lit("long"), F.lit("short"), F.lit("both")], c("p_partkey")).alias("predicted_direction"), c("p_size").alias("horizon_bars"),
    ), "hypotheses")


def tests(spark: SparkSession, sf: str) -> DataFrame:
    """A test for each event, of its user's hypothesis; purchases pass."""
    c = F.col
    passed = c("event_type") == "purchase"
    card = F.struct(
        F.when(passed, "promote").otherwise("reject").alias("verdict"), passed.alias("passed"),
        F.struct((c("event_id") % 90).alias("n_trades"), (c("event_id") % 41 / 8.0 - 2).alias("sharpe")).alias("overall"), F.array(F.concat(F.lit("saw "), c("event_type"))).alias("rejection_reasons"),
    )
    return _shaped(table(spark, sf, "events").select((c("event_id") + 1).alias("id"), (c("user_id") + 1).alias("hypothesis_id"), (c("event_id") % 20 + 1).alias("n_trials"), passed.alias("passed"), F.to_json(card).alias("scorecard")), "tests")


def holdout(spark: SparkSession, sf: str) -> DataFrame:
    """A use of the holdout for each customer; a market segment in a nation is the strategy."""
    c = F.col
    name = F.concat_ws("_", F.lower("c_mktsegment"), c("c_nationkey").cast("string"))
    return _shaped(table(spark, sf, "customer").select((c("c_custkey") + 1).alias("id"), name.alias("strategy_name"), (c("c_acctbal") > 9000).alias("passed")), "holdout_access")


def strategies(spark: SparkSession, sf: str) -> DataFrame:
    """A version of a strategy for each order; its customer's orders share the name."""
    c = F.col
    looks = [F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(">").alias("op"), F.lit(1.0).alias("value")) for n in names]) for names in LOOKS]
    name = F.concat(F.lit("strategy_"), c("o_custkey").cast("string"))
    genome = F.struct(name.alias("name"), F.when(c("o_custkey") % 2 == 0, "long").otherwise("short").alias("direction"), _dealt([F.lit(h) for h in HORIZONS], c("o_orderkey")).alias("horizon"), _dealt(looks, c("o_orderkey")).alias("conditions"))
    card = F.struct(F.struct((c("o_orderkey") % 41 / 8.0 - 2).alias("sharpe")).alias("overall"))
    made = table(spark, sf, "orders").select(
        (c("o_orderkey") + 1).alias("id"), name.alias("name"), (c("o_orderkey") % 7).alias("generation"), F.to_json(genome).alias("genome"), (c("o_totalprice") / 1_000_000).alias("fitness"),
        c("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("passed"), F.when(c("o_orderstatus") == "P", "retired:decayed").otherwise("active").alias("status"), F.to_json(card).alias("scorecard"),
    )
    return _shaped(store.niche(made), "strategies")


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(index, value): the audit log, a line for each event by time; those of errors are malformed."""
    c = F.col
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), c("event_type").alias("type"), c("event_id").alias("n")))
    lines = table(spark, sf, "events").select("ts", "event_id", F.when(c("event_type") == "error", "not json").otherwise(line).alias("value"))
    return eventlog.numbered(lines, ["ts", "event_id"]).select("index", "value")


def books(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, bids, asks): an order's line items by price, the best first; discounts are levels above 100 and taxes levels below.

    Quantities are summed by level before they are listed, so a side has at most a dozen entries.
    """
    c = F.col
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.rint(100 * c(of)).alias("level")) for side, of in (("ask", "l_discount"), ("bid", "l_tax"))]))
    levels = table(spark, sf, "lineitem").select(c("l_orderkey").alias("symbol"), "l_quantity", sides.alias("x")).groupBy("symbol", "x.side", "x.level").agg((F.sum("l_quantity") / 8).alias("qty"))

    def listed(side: str, sign: int) -> F.Column:
        entries = F.array_sort(F.collect_list(F.when(c("side") == side, F.struct("level", "qty"))))
        return F.transform(entries, lambda x: F.struct((100 + sign * (x["level"] + 1) / 2).alias("price"), x["qty"].alias("qty")))

    return levels.groupBy("symbol").agg(listed("bid", -1).alias("bids"), listed("ask", 1).alias("asks"))
