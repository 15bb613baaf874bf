"""Tables that cut lineage: written to the folder that the session shares with its executors, and read again."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session without either gets one of its own, beside the warehouse.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder (as a URI) below the shared one."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


class Scratch:
    """Tables below a new shared folder.  What is read again is the same for every task and attempt."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.folder, self.held = spark, shared_folder(spark, kind), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.held += 1
        path = f"{self.folder}/{self.held}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, n: int, by: str) -> DataFrame:
        """As keep(), in n buckets by a column: grouping by it moves no row.  The catalogue has the table's name only until it is resolved."""
        self.held += 1
        name = f"spark_catalog.default.bucketed_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{self.folder}/{self.held}").bucketBy(n, by).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # of an outside path: the files stay
        return out

    def drop(self) -> None:
        """Delete the tables; nothing that is still to be computed may need them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """After a step that moved much: Spark deletes the shuffle files of frames that are gone when the driver collects its garbage, which else may take long."""
    spark.sparkContext._jvm.System.gc()


_owner: ContextVar[list | None] = ContextVar("owner", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Own the tables that written() makes within: they are deleted at the end, when what was computed from them must be done.

    Scopes nest; without one, tables stay in the shared folder until that is cleaned.
    """
    own: list[Scratch] = []
    token = _owner.set(own)
    try:
        yield
    finally:
        _owner.reset(token)
        for x in own:
            x.drop()


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, for frames that are read several times; scope() says how long it stays."""
    scratch = Scratch(df.sparkSession, "table")
    if (own := _owner.get()) is not None:
        own.append(scratch)
    return scratch.keep(df)
