import os
import random

import numpy as np

from tidemark.functions.kept import shared_root
from tidemark.llm import ngram_join
from tidemark.llm.ngram_join import one_of_each, similarity_components, tree_links


def sets_of(texts, n):
    out = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(ids, texts, n, num, den):
    s = sets_of(texts, n)
    up = list(range(len(s)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                up[root(i)] = root(j)
    comp = {}
    for i, d in enumerate(ids):
        comp.setdefault(root(i), []).append(d)
    return [(d, len(s[i]), min(comp[root(i)])) for i, d in enumerate(ids)]


def corpus(rng, count):
    vocab = [f"W{i}" for i in range(400)]
    texts = []
    while len(texts) < count:
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 11, 14, 25, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(max(1, len(w)))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [*map(str.lower, w[k : k + 1]), "x"]])
            texts.append(rng.choice([" ", "\n"]).join(w))
    return texts


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "SMALL", 5)
    monkeypatch.setattr(ngram_join, "FEW", 4)
    rng = random.Random(3)
    texts = [None, "", " \t", *corpus(rng, 300)]
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, ["q"] * len(ids))), "doc_id long, text string, rid string").repartition(4)
    for n, num in ((3, 90), (2, 80)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similarity_components(df, n, num, 100).collect())
        assert got == sorted(brute(ids, texts, n, num, 100))


def test_many_size_classes(spark):
    """Close to 1 there are hundreds of size classes; none may run into another."""
    rng = random.Random(5)
    rows = []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    rows += [(100 + i, " ".join(f"v{k}" for k in range(i * 7 + 1))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for num in (95, 98, 99):
        assert len(ngram_join.size_classes(20000, num, 100)[0]) > (256 if num > 97 else 100)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similarity_components(df, 3, num, 100).collect())
        assert got == sorted(brute(*zip(*rows), 3, num, 100))


def test_linked_sets_share_a_signature():
    rng = random.Random(12)
    for num in (80, 90):
        starts, differ = ngram_join.size_classes(700, num, 100)
        for _ in range(1500):
            n = rng.choice([2, 5, 9, 10, 11, 15, 30, 120, 600])
            a = {rng.getrandbits(64) for _ in range(n)}
            most = int((100 - num) * 2 * n / (num + 100)) + 2
            b = set(a)
            for x in rng.sample(sorted(a), min(n - 1, rng.randint(0, most))):
                b.discard(x)
            b |= {rng.getrandbits(64) for _ in range(rng.randint(0, most))}
            if a != b and 100 * len(a & b) >= num * len(a | b):
                x, y = (dict(ngram_join.signatures(np.array(sorted(s), np.uint64), starts, differ)) for s in (a, b))
                assert any(len(np.intersect1d(x[k], y[k])) >= ngram_join.ranges_of(int(differ[k]))[1] for k in x.keys() & y.keys())


def test_tree_prunes_no_link():
    rng = random.Random(4)
    for trial in range(20):
        base = [rng.getrandbits(64) for _ in range(60)]
        sets = [np.unique(np.array([x for x in base if rng.random() < 0.95] + [rng.getrandbits(64) for _ in range(rng.randint(0, 6))], np.uint64)) for _ in range(rng.randint(2, 60))]
        cut = rng.randint(1, len(sets) - 1)
        for left, right in ((sets, None), (sets[:cut], sets[cut:])):
            links = tree_links(left, right, 80, 100)
            up = list(range(len(sets)))

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for a, b in links:
                assert root(a) != root(b)
                up[root(a)] = root(b)
            for a in range(len(sets)):
                for b in range(a):
                    if right is None or (b < cut <= a):
                        i = len(np.intersect1d(sets[a], sets[b]))
                        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                            assert root(a) == root(b)


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g h", "u"), (2, "A b c d e f g h", "v"), (2, "A b c d e f g h", "v"), (None, None, None), (7, "", "w"), (None, "a b c d e f g h", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, b string")
    got = one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[4]], df.schema).collect()))
    assert one_of_each(df.limit(0)).count() == 0


def test_rows_lie_on_disk_once(spark, monkeypatch):
    """Dealt out once, into one table: nothing is persisted beside it, and no pass or cogroup moves texts again."""

    def persist(*_):
        raise AssertionError("rows are kept a second time")

    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(200)), "u") for i in range(200)] + [(900, None, "n"), (901, "", "e"), (902, "a b", "s"), (903, "A  b", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, b string").repartition(3)
    monkeypatch.setattr(type(df), "persist", persist)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = one_of_each(df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # of the ids that stand
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(rows[:-1], df.schema).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    root = shared_root(spark).removeprefix("file://")
    assert not [x for x in os.listdir(root) if x.startswith("numbered-")]
