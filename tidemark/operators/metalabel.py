"""Meta-labels: does a trade that a strategy proposes pay, given the context it fires in?"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kept import written
from ..functions.order import sums_below
from .folds import members
from .statistics import ORDER
from .trades import with_features

# The context that the model sees.
CONTEXT = ("volatility_24", "volatility_168", "atr_pct", "return_zscore", "quote_volume_z", "taker_buy_share_z", "range_position", "funding_z", "funding_cum_7d", "beta_168", "momentum_24", "momentum_168")


def training_set(trades: DataFrame, frame: DataFrame) -> DataFrame:
    """trades with the context at entry (0 where unknown) and meta_label, 1 for a net gain."""
    names = [c for c in CONTEXT if c in frame.columns]
    t = with_features(trades, frame, names)
    zero = {c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).otherwise(0.0) for c in names}
    return t.withColumns(zero).withColumn("meta_label", (F.col("net_return") > 0).cast("int"))


def auc(scored: DataFrame, keys: list[str], score: str = "p", label: str = "meta_label") -> DataFrame:
    """Exact area under the curve (ties count half); null with one class only.

    Labels are counted by score, and scores below one by sums of these counts, so that a
    group's scores are never in one order in one task.
    """
    brier = scored.groupBy(*keys).agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"), F.count("*").alias("n_test"))
    known = scored.select(*keys, F.col(score).alias("score_"), F.col(label).cast("bigint").alias("up_"), (1 - F.col(label)).cast("bigint").alias("down_"))
    d = sums_below(known, keys, "score_", ["up_", "down_"])
    won = F.sum(F.col("up_") * (F.col("below_down_") + F.col("down_") / 2))
    g = d.groupBy(*keys).agg((won / F.nullif(F.sum("up_") * F.sum("down_"), F.lit(0))).alias("auc"))
    return g.join(brier, keys).select(*keys, "auc", "brier", "n_test")


def classifier(names: list[str], trees: int = 80, seed: int = 0):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="context"), GBTClassifier(featuresCol="context", labelCol="meta_label", maxIter=trees, maxDepth=3, seed=seed)])


def cross_validated(data: DataFrame, splits: int = 6, embargo: float = 0.01, min_samples: int = 100, trees: int = 80) -> DataFrame:
    """(fold, auc, brier, n_test) of models fitted on the purged train rows of each fold.

    Folds whose train or test rows have one class are left out; so is everything with fewer
    than min_samples rows.  data is one strategy's training set.
    """
    from pyspark.ml.functions import vector_to_array

    names = [c for c in CONTEXT if c in data.columns]
    data = written(data)
    if data.count() < min_samples:
        return data.sparkSession.createDataFrame([], "fold int, auc double, brier double, n_test bigint")
    t = data.withColumn("pos", F.row_number().over(W.partitionBy("strategy").orderBy(*ORDER)) - 1)
    fold = members(data, ["strategy"], splits, embargo)
    t = written(t.join(fold, ["strategy", "pos"]))
    kinds = [F.count_distinct(F.when(F.col("role") == x, F.col("meta_label"))).alias(x) for x in ("train", "test")]
    ready = [r.fold for r in t.groupBy("fold").agg(*kinds).collect() if r.train == 2 and r.test == 2]  # a handful of folds

    def fitted(fold: int) -> DataFrame:
        own = t.where(F.col("fold") == fold)
        model = classifier(names, trees).fit(own.where("role = 'train'"))
        return auc(model.transform(own.where("role = 'test'")).select("fold", "meta_label", vector_to_array("probability")[1].alias("p")), ["fold"])

    with ThreadPool(max(1, len(ready))) as pool:  # a fit is many small jobs: folds run side by side
        out = pool.map(inheritable_thread_target(data.sparkSession)(fitted), ready)
    return reduce(DataFrame.unionByName, out) if out else data.sparkSession.createDataFrame([], "fold int, auc double, brier double, n_test bigint")


def usable(folds: DataFrame, least: float = 0.55) -> DataFrame:
    """One row: mean_auc over the folds of cross_validated(), how many, and whether the model adds anything."""
    mean = F.avg("auc")
    return folds.agg(mean.alias("mean_auc"), F.count("*").alias("folds"), F.coalesce(mean > least, F.lit(False)).alias("usable"))


def trained(data: DataFrame, path: str | None = None, trees: int = 80):
    """A model on all rows, saved to path (any file system that Spark knows) if given."""
    names = [c for c in CONTEXT if c in data.columns]
    model = classifier(names, trees).fit(data)
    if path is not None:
        model.write().overwrite().save(path)
    return model


def importances(model) -> DataFrame:
    """(feature, gain) of a model: the share of all splits' gain that a feature's splits have, the largest first."""
    names, gain = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    spark = SparkSession.active()
    return spark.createDataFrame([(n, float(g)) for n, g in zip(names, gain, strict=True)], "feature string, gain double").orderBy(F.desc("gain"), "feature")


def permuted(model, test: DataFrame, label: str = "meta_label", order: tuple[str, ...] = ORDER, seed: int = 0) -> DataFrame:
    """(feature, auc, loss): the area under the curve with one feature's values dealt to other rows, and what that loses.

    All features are dealt by one permutation, the order of a hash, so that rows meet their
    partners in one join and every variant is scored in one pass; the largest loss first.
    """
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].getInputCols()
    t = test.select(*[F.col(c).alias(c) for c in names], label, F.struct(*order).alias("own_"), F.lit(1).alias("one_"))
    rows = written(running(t.withColumn("hash_", F.xxhash64("own_", F.lit(seed)))))
    partner = rows.select(F.col("by_hash_").alias("by_own_"), F.struct(*names).alias("other_"))
    both = rows.join(partner, "by_own_")
    variants = both.withColumn("feature", F.explode(F.array(F.lit(""), *[F.lit(n) for n in names])))
    dealt = variants.select("feature", label, *[F.when(F.col("feature") == n, F.col("other_")[n]).otherwise(F.col(n)).alias(n) for n in names])
    scored = model.transform(dealt).select("feature", F.col(label).alias("meta_label"), vector_to_array("probability")[1].alias("p"))
    got = auc(scored, ["feature"])
    base = F.broadcast(got.where("feature = ''").select(F.col("auc").alias("base_")))  # one row
    return got.where("feature <> ''").crossJoin(base).select("feature", "auc", (F.col("base_") - F.col("auc")).alias("loss")).orderBy(F.desc("loss"), "feature")


def running(t: DataFrame) -> DataFrame:
    """t with by_own_ and by_hash_, the rows' places in the order of own_ and of hash_ (ties: own_)."""
    for name, order in (("by_own_", ["own_"]), ("by_hash_", ["hash_", "own_"])):
        parts = written(t.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
        sizes = parts.groupBy("part_").agg(F.count("*").alias("n_"))
        before = sizes.select("part_", F.coalesce(F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
        own = F.row_number().over(W.partitionBy("part_").orderBy(*order)) - 1
        t = parts.withColumn(name, own).join(F.broadcast(before), "part_").withColumn(name, F.col(name) + F.col("before_")).drop("part_", "before_")
    return t


def loaded(spark: SparkSession, path: str):
    """The model saved at path, or None if there is none."""
    from pyspark.ml import PipelineModel

    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    return PipelineModel.load(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def success_probability(data: DataFrame, model) -> DataFrame:
    """data with p_success, the model's probability that a trade in this context pays; null without a model.

    Context that is missing, null or not finite counts as 0.
    """
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return data.withColumn("p_success", F.lit(None).cast("double"))
    names = model.stages[0].getInputCols()
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    held = data.withColumn("row_", F.struct(*data.columns)).select("row_", *[F.when(known(c), F.col(c)).otherwise(0.0).alias(c) if c in data.columns else F.lit(0.0).alias(c) for c in names])
    return model.transform(held).select("row_.*", vector_to_array("probability")[1].alias("p_success"))
