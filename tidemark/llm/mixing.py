"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

The mix holds `share` of all words.  Each source has a weight; its target is
min(cap, level * weight), the cap being max_epochs times its own words.  The level is
raised until the sources that it clamps at their caps no longer change: what a clamped
source can't take is reshared by weight among the others.

A source's target is then whole repetitions of all its documents and a fraction: its
documents in the order of a seeded hash, up to the words that are left.  The cut in that
order is found by radix selection, 12 bits of the hash at a time, with sums of at most
4096 digits a source; no source's rows are sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, positioned

WORD = r"[^\x20\x09-\x0D]+"
_BITS, _DIGIT = 48, 12
#: Sources up to which their targets are broadcast.
BROADCAST_SOURCES = 50_000


def words_in(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(id, seed: int) -> Column:
    """The 48-bit place of a document in its source's order; documents with equal ids share one."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("null")))), 1, _BITS // 4), 16, 10).cast("bigint")


def water_level(sources: DataFrame, share: float) -> float:
    """The level at which min(cap, level * weight) adds up to share of all words; sources has total, cap and weight."""
    total, weight = sources.agg(F.sum("total"), F.sum("weight")).first()
    goal, level, clamped = share * (total or 0), 0.0, None
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        cap, rest, n = sources.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == clamped or not rest:
            return level
        clamped, level = n, max(level, (goal - (cap or 0)) / rest)


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, total, target, whole, cut, rest, tied) for each source of sized (source, size, place).

    whole repetitions, and once more every document before the place `cut`; those at it
    share `rest` words in proportion to their sizes, which add up to `tied`.
    """
    totals = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("total"), F.lit(1).alias("one")))
    ranked = positioned(totals.withColumn("missing", F.col("source").isNull()), [F.col("missing"), F.col("source")], {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    sources = checkpointed(ranked.select("source", "total", (F.col("total") * max_epochs).alias("cap"), weight.alias("weight")))
    level = F.lit(water_level(sources, share)) * F.col("weight")
    target = F.when(F.col("cap") <= level, F.col("cap").cast("double")).otherwise(level)
    words = F.floor("target")
    out = sources.select("source", "total", target.alias("target"))
    out = out.withColumn("whole", F.when(F.col("total") > 0, F.floor(words / F.col("total"))).otherwise(0).cast("bigint"))
    out = out.withColumn("rest", (words - F.col("whole") * F.col("total")).cast("bigint")).withColumn("cut", F.lit(0).cast("bigint"))
    by = W.partitionBy("source").orderBy("digit")
    for done in range(0, _BITS, _DIGIT):
        left = _BITS - done - _DIGIT
        s, o = sized.alias("s"), out.where("rest > 0").select(F.col("source").alias("of"), F.col("rest").alias("left"), F.col("cut").alias("at"))
        inside = s.join(o, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("place", left + _DIGIT) == F.col("at")))
        digits = inside.groupBy("source", F.shiftright("place", left).alias("digit")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        digits = digits.withColumn("upto", F.sum("n").over(by))
        found = digits.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("n") < F.col("left")))
        found = found.select(F.col("source").alias("of"), F.col("digit"), (F.col("left") - F.col("upto") + F.col("n")).alias("still"), F.col("n").alias("tied"))
        out = out.drop("tied").join(found, F.col("source").eqNullSafe(F.col("of")), "left")
        out = checkpointed(out.select("source", "total", "target", "whole", F.coalesce("still", F.lit(0).cast("bigint")).alias("rest"), F.coalesce("digit", F.lit(0).cast("bigint")).alias("cut"), F.coalesce("tied", F.lit(1).cast("bigint")).alias("tied")))
    return out


def _taken(sized: DataFrame, planned: DataFrame) -> DataFrame:
    p = planned.withColumnRenamed("source", "of")
    if p.count() <= BROADCAST_SOURCES:  # a row each; otherwise Spark shuffles and splits hot sources
        p = F.broadcast(p)
    some = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), F.floor(F.col("size") * F.col("rest") / F.col("tied"))).otherwise(0)
    taken = F.col("whole") * F.col("size") + F.when(F.col("rest") > 0, some).otherwise(0)
    return sized.join(p, F.col("source").eqNullSafe(F.col("of"))).withColumn("taken", taken.cast("bigint"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, source, size, source_size, target, taken) for every row of docs.

    Size: the words `[^\\x20\\x09-\\x0D]+` of the text (null: 0).  Sources in code-point
    order, null last and a source of its own, weigh weights[0], weights[1], ... in turn.
    taken is the number of words that the mix takes of the row, repeats counted: whole
    repetitions, and for the row at its source's cut a part of one; at most max_epochs
    times the size.  Each source's taken words differ from its target by less than one
    word (by less than one a row at the cut, where ids repeat).  The same rows and seed
    give the same result.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), place(id, seed).alias("place"))
    rows = checkpointed(rows)
    out = _taken(rows, plan(rows.select("source", "size", "place"), weights, share, max_epochs))
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", F.col("total").alias("source_size"), "target", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself, with docs' columns: a row for each repetition of a document.

    Texts are never cut: the row at its source's cut comes once more if the mix takes half of
    its words or more there, so a source's words differ from its target by half of one row's at
    most (of each row there, where ids repeat).  Rows without words come as often as their
    source repeats whole.
    """
    keep = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    own = docs.select(F.col(source).alias("source"), words_in(F.col(text)).alias("size"), place(id, seed).alias("place"), *keep)
    narrow = checkpointed(own.select("source", "size", "place"))
    out = _taken(own, plan(narrow, weights, share, max_epochs))
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.col("whole"))
    out = out.select(*[f"c{i}" for i in range(len(docs.columns))], F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("n_"))
    return out.drop("n_").toDF(*docs.columns)
