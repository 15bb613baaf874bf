"""Reports of trade ideas: written as JSON lines and as text, listed and read by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_of(ideas: DataFrame, title: str) -> DataFrame:
    """(value): the lines of a report, the idea with the largest expected value first.

    ideas: symbol, direction, entry, stop, target, net_ev_pct, position_pct; a handful.
    """
    rank = F.struct((-F.coalesce("net_ev_pct", F.lit(float("-inf")))).alias("ev"), "symbol", "direction")
    line = F.format_string("- %s %s: entry %.6g, stop %.6g, target %.6g, expected %.3f %%, size %.2f %%", "symbol", "direction", "entry", "stop", "target", "net_ev_pct", "position_pct")
    body = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), line.alias("line")))), lambda x: x["line"])
    return ideas.agg(F.concat(F.array(F.lit(f"# {title}"), F.lit("")), body).alias("lines")).select(F.explode("lines").alias("value"))


def save(ideas: DataFrame, root: str, name: str, title: str) -> None:
    if not re.fullmatch(r"[\w\-]+", name):
        raise ValueError("a report's name is made of letters, digits, _ and -")
    ideas.coalesce(1).write.mode("overwrite").json(f"{root}/{name}.json")
    text_of(ideas, title).coalesce(1).write.mode("overwrite").text(f"{root}/{name}.md")


def names(spark: SparkSession, root: str) -> list[str]:
    """The names of the reports below root, the last in order first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted((x.removesuffix(".md") for x in found if x.endswith(".md")), reverse=True)


def read(spark: SparkSession, root: str, name: str) -> str:
    """The text of a report; only plain names are taken, no paths."""
    if not re.fullmatch(r"[\w\-]+", name):
        raise ValueError("no such report")
    return "\n".join(r.value for r in spark.read.text(f"{root}/{name}.md").collect())
