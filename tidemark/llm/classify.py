"""What the text classifiers share: folds, bounded labelled samples, scoring."""

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal


def fold(id: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 5


def order(id: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("")))


def smallest(df: DataFrame, id: str, seed: int, most: int, text: str | None = None) -> DataFrame:
    """The rows that come first in a seeded order of ids, and of texts where ids are equal: all, or `most` of them.

    Rows with equal ids and texts count as one, so that never more come than asked for.
    """
    keyed = df.select("*", order(id, seed).alias("h_"), (F.xxhash64(text) if text else F.lit(0).cast("bigint")).alias("t_"))
    last = keyed.select(F.struct("h_", "t_").alias("k")).orderBy("k").limit(most).agg(F.max("k"), F.count("*")).first()
    if last[1] == most:
        keyed = keyed.where((F.col("h_") < last[0].h_) | ((F.col("h_") == last[0].h_) & (F.col("t_") <= last[0].t_)))
    return keyed.dropDuplicates(["h_", "t_"]).drop("h_", "t_")


def training_labels(labels: DataFrame, id: str, label: str, value: int | None = None) -> DataFrame:
    """(id, y) of the ids outside the held-out fold; an id with differing labels has the smaller."""
    out = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & (fold(id) != 0)).groupBy(F.col(id).alias(id)).agg(F.min(label).cast("int").alias("y"))
    return out if value is None else out.where(F.col("y") == value)


class Marked:
    """Counts the characters of a text that a test of one character accepts, by a table for most of them."""

    def __init__(self, test: Callable[[str], bool]):
        self.test, self.table = test, np.fromiter((test(chr(i)) for i in range(1 << 16)), bool, 1 << 16)

    def __call__(self, t: str) -> int:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        far = c >= 1 << 16
        return int(self.table[c[~far]].sum()) + sum(self.test(chr(x)) for x in c[far]) if far.any() else int(self.table[c].sum())


@cache
def marked(test: Callable[[str], bool]) -> Marked:
    return Marked(test)


def feature_rows(rows: DataFrame, text: str, features: Callable[[str], list[float]], carry: list[str]) -> DataFrame:
    """carry and x, the features of each text."""
    bounded_batches(rows.sparkSession)

    @F.pandas_udf("array<double>")
    def x(t: pd.Series) -> pd.Series:
        frugal()
        return pd.Series([features(s or "") for s in t])

    return rows.select(*carry, x(text).alias("x"))


def scored(docs: DataFrame, text: str, score: Callable[[list], np.ndarray]) -> Column:
    """score: texts to numbers from 0 to 1."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def f(t: pd.Series) -> pd.Series:
        frugal()
        out = np.zeros(len(t))
        texts = t.tolist()
        for k in range(0, len(texts), 256):
            out[k : k + 256] = score([s or "" for s in texts[k : k + 256]])
        return pd.Series(out)

    return f(text)
