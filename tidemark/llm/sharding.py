"""Minimax contiguous sharding, in DataFrame operations only.

Rows with equal texts are one atomic group.  Groups are ordered by their smallest id and
laid end to end; each group's end in bytes is a place where a cut is allowed.  The
smallest capacity for which greedy cutting needs no more than the given shards is found
by binary search, and the shards are cut so that none is larger.

The driver never holds all places: it holds the first, the last and the number of places
in each of some thousand byte ranges, with which a greedy walk is bounded from both
sides.  Ranges in which the two walks still differ are divided again until they agree.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, positioned

#: Byte ranges at first, and those that a range is divided into.
RANGES, FINER = 4096, 16


class _Places:
    """Cut places known as (first, last, how many) for ranges of bytes."""

    def __init__(self, total: int):
        self.total, self.known = total, {}

    def sort(self) -> None:
        self.keys = sorted(self.known, key=lambda k: self.known[k][0])
        self.firsts = [self.known[k][0] for k in self.keys]

    def last(self, x: int, hopeful: bool, unsure: set | None = None) -> int:
        """The last place up to x; where unknown, the last known one, or x itself if hopeful."""
        i = bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0
        first, last, n = self.known[self.keys[i]]
        if x >= last:
            return last
        if n > 2:
            if unsure is not None:
                unsure.add(self.keys[i])
            if hopeful:
                return x
        return first

    def walk(self, at: int, capacity: int, shards: int, hopeful: bool, unsure: set | None = None) -> list[int]:
        """The cuts of greedy shards from a place on; as far as they come."""
        cuts = []
        while at < self.total and len(cuts) < shards:
            to = self.last(at + capacity, hopeful, unsure)
            if to <= at:
                break
            cuts.append(at := to)
        return cuts

    def fits(self, at: int, capacity: int, shards: int, hopeful: bool) -> bool:
        return at >= self.total or (self.walk(at, capacity, shards, hopeful) or [0])[-1] >= self.total

    def smallest(self, shards: int, hopeful: bool) -> int:
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fits(0, mid, shards, hopeful):
                hi = mid
            else:
                lo = mid + 1
        return lo

    def between(self, low: list[int], high: list[int]) -> set:
        """Ranges of more than two places that meet any [low cut, high cut]."""
        out = set()
        for a, b in zip(low + [self.total] * (len(high) - len(low)), high + [self.total] * (len(low) - len(high)), strict=True):
            for i in range(max(0, bisect_right(self.firsts, min(a, b)) - 1), bisect_right(self.firsts, max(a, b))):
                first, last, n = self.known[self.keys[i]]
                if n > 2 and last > min(a, b):
                    out.add(self.keys[i])
        return out


def minimax_cuts(places: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, cuts) for the distinct ascending places (column P) of group ends."""
    if not total:
        return 0, []
    p = _Places(total)
    width = max(1, -(-total // RANGES))

    def summary(df: DataFrame, w: int) -> None:
        for r in df.groupBy(F.floor((F.col("P") - 1) / w).alias("k")).agg(F.min("P").alias("a"), F.max("P").alias("z"), F.count("*").alias("n")).collect():
            p.known[(w, r.k)] = (r.a, r.z, r.n)
        p.sort()

    summary(places, width)
    while True:
        low, high = p.smallest(shards, True), p.smallest(shards, False)
        unsure: set = set()
        a, b = p.walk(0, low, shards, False, unsure), p.walk(0, high, shards, True, unsure)
        unsure |= p.between(a, b)
        if not unsure:
            break
        w = max(k[0] for k in unsure)  # widest first; all of one width at a time
        some = [k for k in unsure if k[0] == w]
        for k in some:
            del p.known[k]
        finer = max(1, w // FINER)
        ranges = places.sparkSession.createDataFrame([(int(k[1]),) for k in some], "k bigint")
        inside = places.withColumn("k", F.floor((F.col("P") - 1) / w)).join(F.broadcast(ranges), "k", "left_semi")
        summary(inside.drop("k"), finer)
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        if at >= total:
            break
        even = p.last(at + -(-(total - at) // left), False)
        at = even if even > at and p.fits(even, high, left - 1, False) else p.last(at + high, False)
        cuts.append(at)
    return high, cuts


def shard_rows(docs: DataFrame, shards: int = 40, overhead: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs.

    size: the text's UTF-8 bytes (null: none) plus overhead.  Rows with equal texts share a
    shard (null texts are equal to each other); shards follow each other in the order of
    the groups' smallest ids (null last) and none is larger than the smallest capacity for
    which that order fits into so many shards.  slot counts a shard's rows from 0, in
    order of group and id.  With one group larger than an even share, some
    shards are smaller, and with fewer groups than shards some stay empty.  Repeated rows are
    placed one by one.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("bigint").alias("size"), F.crc32(F.col(text).cast("binary")).alias("crc"), F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")).alias("key"))
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("first")))  # cut here, a hot key's side of the join can be split
    laid = rows.join(groups, "key").select("id", "size", "crc", "key", "first", F.col("id").isNull().alias("no"), F.monotonically_increasing_id().alias("tie"), F.lit(1).alias("one"))
    laid = positioned(laid, ["first", "key", "no", "id", "tie"], {"P": "size", "R": "one"})
    ends = checkpointed(laid.groupBy("key").agg(F.max("P").alias("P")).select("P"))
    total = ends.agg(F.max("P")).first()[0] or 0
    _, cuts = minimax_cuts(ends, total, shards)
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts[:-1]]), lambda c: c < F.col("P"))) if len(cuts) > 1 else F.lit(0)
    out = laid.withColumn("shard", shard.cast("int"))
    starts = {r.shard: r.at for r in out.groupBy("shard").agg(F.min("R").alias("at")).collect()}
    start = F.element_at(F.array(*[F.lit(starts.get(k, 0)).cast("bigint") for k in range(max(starts, default=0) + 1)]), F.col("shard") + 1)
    return out.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("R") - start).cast("bigint").alias("slot"))
