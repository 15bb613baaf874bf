"""What the operators of this subpackage share: checkpoints, row batches, components.

Row batches.  Text operators that exchange hashes between documents deal the rows
once into `nb` batches of about `BATCH_BYTES` of text (`Batches`), keep that
frame for reuse (texts zstd-compressed), and then talk to each other in packed
binary rows: (bucket, batch, bytes).  A batch or a bucket is what one task holds in
memory, so memory is bounded by the batch size and not by any key, source or group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.kept import Scratch, shared_folder, swept
from ..functions.kept import written as checkpointed

#: Text bytes in a row batch, on average.
BATCH_BYTES = 4 << 20
#: Rows in one Arrow batch between the JVM and a Python worker, at most.
ARROW_ROWS = 1000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small: with long texts, the default of 10,000 rows fills a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def frugal() -> None:
    """In a worker: have freed arrays go back to the system, as idle workers stay alive beside the JVM."""
    import ctypes
    import contextlib

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.default_memory_pool().release_unused()


class Batches:
    """Rows as (b, rid, c0, c1, ..., z), dealt evenly into nb batches.

    c0, c1, ... are the columns asked for, under names that clash with none; rid tells rows
    apart even if all their values are equal; z is the text as zstd-compressed UTF-8 (null
    stays null).  The numbered rows are a written table, so that a lost task finds the same
    rid again whatever docs came from; `rows` is that table dealt out by b and persisted
    until release(); `again` deals it out anew, for results that are computed later.

    stored: rows are dealt out once into a table bucketed by b, which takes the place of the
    numbered one and of what is persisted.  So they lie on disk once, whatever memory there is, and
    no pass or cogroup by b moves them again.
    """

    def __init__(self, docs: DataFrame, keep: list[str], text: str = "text", stored: bool = False):
        spark = docs.sparkSession
        bounded_batches(spark)
        self.scratch = Scratch(spark, "rows")
        kept = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)], F.col(f"`{text}`").alias("z"))
        schema = T.StructType([*kept.schema.fields[:-1], T.StructField("size", T.LongType()), T.StructField("z", T.BinaryType())])

        def squeeze(batches):
            frugal()
            c = zstandard.ZstdCompressor(level=1)
            for x in batches:
                raw = [None if t is None else t.encode("utf-8", "replace") for t in x.column(x.num_columns - 1).to_pylist()]
                size = pa.array([0 if t is None else len(t) for t in raw], pa.int64())
                z = pa.array([None if t is None else c.compress(t) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], size, z], names=schema.names)

        first = Scratch(spark, "numbered") if stored else self.scratch
        numbered = first.keep(kept.mapInArrow(squeeze, schema))
        total = numbered.agg(F.sum("size")).first()[0] or 0
        self.nb = max(shuffle_partitions(spark), math.ceil(total / BATCH_BYTES))
        self.table = numbered.select(self.batch_of("rid"), *[c for c in schema.names if c != "size"])
        if stored:
            self.table = self.rows = self.scratch.bucketed(self.again(), self.nb, "b")
            first.drop()
            swept(spark)
        else:
            self.rows = self.again().persist(StorageLevel.MEMORY_AND_DISK)

    def batch_of(self, rid: str):
        """The batch of a row, wherever its rid is at hand."""
        return F.pmod(F.xxhash64(rid), F.lit(self.nb)).cast("int").alias("b")

    def again(self) -> DataFrame:
        return self.table.repartition(self.nb, "b")

    def release(self) -> None:
        self.rows.unpersist()


def texts_of(table: pa.Table, column: str = "z") -> list[bytes]:
    """The texts of row_batches() as UTF-8; null as no bytes."""
    frugal()
    d = zstandard.ZstdDecompressor()
    return [b"" if z is None else d.decompress(z) for z in table.column(column).to_pylist()]


def sorted_batch(table: pa.Table) -> pa.Table:
    """The batch in order of rid, so that every pass numbers its rows alike."""
    return table.sort_by("rid")


def buckets_of(h: np.ndarray, nb: int) -> np.ndarray:
    """Bucket of each uint64 hash, from its high 32 bits."""
    return (((h >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)).astype(np.int64)


def by_bucket(h: np.ndarray, nb: int):
    """(bucket, indexes into h) for each bucket that has any; h need not be sorted."""
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    g = buckets_of(h[order], nb)
    cuts = np.flatnonzero(np.diff(g)) + 1
    for part in np.split(order, cuts):
        yield int(buckets_of(h[part[:1]], nb)[0]), part


def carried(keep: list[str]) -> list:
    """The columns of row_batches() under their own names."""
    return [F.col(f"c{i}").alias(k) for i, k in enumerate(keep)]


def pack(h: np.ndarray) -> bytes:
    """The low 40 bits of each uint64; with the bucket, about 46 bits at any size of input."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Union:
    """Union-find over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.up[y] = x
        return True


def positioned(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each name in sums, the running total of that column in the given total order.

    Range partitions are sorted and summed on their own and get the totals of those
    before them; the totals, one row a partition, are what is broadcast.  The result is
    checkpointed, as the bounds of range partitions may differ from run to run.
    """
    spark = df.sparkSession
    d = checkpointed(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("pid_", F.spark_partition_id()))
    totals = d.groupBy("pid_").agg(*[F.sum(c).alias(f"{k}_0") for k, c in sums.items()])
    before = W.orderBy("pid_").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("pid_", *[F.coalesce(F.sum(f"{k}_0").over(before), F.lit(0)).alias(f"{k}_0") for k in sums])
    w = W.partitionBy("pid_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = d.select("*", *[F.sum(c).over(w).alias(k) for k, c in sums.items()])
    return checkpointed(own.join(F.broadcast(totals), "pid_").withColumns({k: F.col(k) + F.col(f"{k}_0") for k in sums}).drop("pid_", *[f"{k}_0" for k in sums]))


#: Edges that one task joins at last.
LAST_EDGES = 1 << 14


def _joined_edges(batches):
    """(node, root) of edges that fit into one task."""
    frugal()
    parts = [np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]) for x in batches if x.num_rows]
    if parts:
        ids, k = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        seen = Union(len(ids))
        for a, b in k.reshape(2, -1).T.tolist():
            seen.join(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[seen.root(i) for i in range(len(ids))]])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (x, y), both bigint and not null.

    Contraction: each node hooks to the first of itself and its neighbours in the order
    of a hash, the edges are renamed, and loops and repeats go; in that random order a
    constant share of the nodes goes each round, on paths as on stars.  Rounds end when
    LAST_EDGES or fewer are left, a bounded number that one task joins.  The maps are then
    composed from the last to the first.  Every round is a partial aggregation and
    equi-joins between written tables; nothing but a count reaches the driver.  Root is one
    node of the component, not necessarily its smallest.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "edges")
    e = scratch.keep(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    maps: list[DataFrame] = []
    while e.count() > LAST_EDGES:
        both = e.select("x", "y").unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        first = F.min(F.struct(F.xxhash64("y").alias("h"), F.col("y").alias("id")))
        hook = both.groupBy(F.col("x").alias("node")).agg(first.alias("to"))
        hook = scratch.keep(hook.select("node", F.least("to", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id")))["id"].alias("root")))
        maps.append(hook)
        hx, hy = hook.toDF("x", "rx"), hook.toDF("y", "ry")
        e = scratch.keep(e.join(hx, "x").join(hy, "y").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).where("x <> y").distinct())
    out = e.coalesce(1).mapInArrow(_joined_edges, "node bigint, root bigint")
    for m in reversed(maps):
        out = m.join(out.toDF("root", "last"), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    out = checkpointed(out)
    scratch.drop()
    return out


#: A key of more than this part of the rows, of which there are fewer than HOT_KEYS, is looked up by broadcast.
HOT_KEYS = 256


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the other columns of table, which has a row for each key of `on` and n_, its rows in `rows`, `total` in all.

    Keys with more than total / HOT_KEYS rows are fewer than HOT_KEYS, whatever the input,
    so these are broadcast and their rows stay where they are; all others meet by a shuffle in which
    no key is large.  rows and table are read twice: written tables, with rows of bounded size.
    """
    large = F.col("n_") * HOT_KEYS > total
    hot, cold = F.broadcast(table.where(large).drop("n_")), table.where(~large).drop("n_")
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on))


def dense_names(scratch: Scratch, rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows, a written table, with a number in place of the key: equal keys have equal numbers, 0 to the number of keys - 1.

    Keys are counted (in part before the shuffle) and numbered where they lie; the counts of
    partitions, a row each, make the numbers dense.  Returns a written table.
    """
    keys = scratch.keep(rows.groupBy(*key).agg(F.count("*").alias("n_")).withColumn("at_", F.monotonically_increasing_id()))
    sizes = keys.groupBy(F.shiftright("at_", 33).alias("part_")).agg(F.count("*").alias("m_"))
    before = F.coalesce(F.sum("m_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("part_", before.alias("before_")))
    named = keys.withColumn("part_", F.shiftright("at_", 33)).join(offsets, "part_")
    named = named.select(*key, "n_", (F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).alias(name))
    return scratch.keep(looked_up(rows, named, key, rows.count()).drop(*key))
