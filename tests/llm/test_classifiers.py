import random

import numpy as np

from tidemark.llm import quality, toxicity


def tables(spark, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(700):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        good, toxic = 1, 0
        if rng.random() < 0.15:
            good = 0
            w = [x + "$$$" for x in w] if rng.random() < 0.5 else [x for x in w[:6] for _ in range(9)]
        elif rng.random() < 0.2:
            toxic = 1
            w.insert(rng.randrange(len(w)), rng.choice(["moron", "vilestuff", "vilething", "vileaa"]))
        docs.append((i, " ".join(w), "score"))
        if rng.random() < 0.8:
            labels.append((i, good, toxic))
    docs += [(10_000, None, "x"), (10_001, "", "x"), (None, "word", "x"), docs[0]]
    labels += [labels[0], (labels[1][0], 1 - labels[1][1], 1 - labels[1][2]), (None, 1, 1), (10_000, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, odd string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_held_out_accuracy(spark):
    d, lab, docs, labels = tables(spark, 8)
    for scores, label, column in ((quality.quality_scores, 1, "quality"), (toxicity.toxicity_scores, 2, "toxic")):
        got = scores(d, lab).collect()
        assert len(got) == len(docs)
        assert all(0 <= r.score <= 1 for r in got)
        truth = {x[0]: x[label] for x in labels[:-4]}
        truth.pop(labels[1][0])
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 60
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
        same = {}
        for r in got:
            assert same.setdefault(r.text or "", r.score) == r.score
        # what the held-out rows are labelled changes nothing
        from pyspark.sql import functions as F

        turned = lab.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(column)).otherwise(F.col(column)))
        assert {(r.text, r.score) for r in scores(d, turned).collect()} == {(r.text, r.score) for r in got}


def test_edges(spark):
    d, lab, *_ = tables(spark, 9)
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(d.limit(0), lab).count() == 0
        assert len({r.score for r in f(d.limit(5), lab.limit(0)).collect()}) == 1
    kept = quality.accepted(d, lab)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def test_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 5000)
    u = np.r_[rng.normal(2, 1, 3000), rng.normal(-2, 1, 2000)]
    assert abs(quality.class_prior(p, u) - 0.6) < 0.06


def test_isotonic_and_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 1)).astype(float)
    start, trees = toxicity.boost(x, y, np.ones(800))
    z = toxicity.tree_sums(x, start, trees)
    assert ((z > 0) == y).mean() > 0.97
    xs, ys = toxicity.isotonic(z, y, np.ones(800))
    assert (np.diff(xs) > 0).all() and (np.diff(ys) >= 0).all()
    assert toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))[1].tolist() == [0, 0.5, 0.5, 1]


def test_capitals_of_the_whole_text():
    f = toxicity.Features({})
    calm = "word " * 2000
    late = calm[:5000] + calm[5000:].title()
    assert f(calm) != f(late)
    assert f(late)[11] == 1000 / len(late)
    assert f(late.swapcase()) == f(late.swapcase()[5000:] + late.swapcase()[:5000])


def test_letters_of_the_whole_text():
    for t in ("a------" * 1000, "-aaaaaa" * 1000, "ab é1 |" * 571 + "x", "word " * 799, "word " * 801):
        assert quality.features(t)[15] == sum(x.isalpha() for x in t) / len(t)


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.classify import smallest

    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert smallest(rows, "id", 3, 100, "text").count() == 100
    same = rows.withColumn("text", F.lit("one text"))
    assert smallest(same, "id", 3, 100, "text").count() == 1
    got = smallest(rows.withColumn("id", F.col("text").substr(6, 9).cast("long")), "id", 3, 100, "text")
    assert got.count() == 100 and sorted(got.columns) == ["id", "text"]


def test_marked_counts_all_characters():
    from tidemark.llm.classify import marked

    for t in ("", "Ab É 𝐀b 𐐀 \ud800", "ÀÉ" * 999):
        for test in (str.isupper, str.isalpha):
            assert marked(test)(t) == sum(map(test, t))
