import random

from tidemark.llm.substring_dedup import remove_repeats


def brute(texts, window):
    ws = [(t or "").encode().split() for t in texts]
    at = {}
    for d, w in enumerate(ws):
        for i in range(len(w) - window + 1):
            at.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in ws]
    for places in at.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return [(len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g).decode()) for w, g in zip(ws, gone)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["é", "A", "a", "x y"]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40))) for _ in range(6)]
    texts = [None, "", "  \n", "one"]
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    texts += [texts[7]] * 3 + ["z " * 50]
    for window in (4, 7, 10):
        rows = [(i if i != 9 else None, t, "x", i) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, b string, rid int").repartition(3)
        got = {r.rid: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, window).collect()}
        want = brute(texts, window)
        assert [got[i] for i in range(len(texts))] == want


def test_spans_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x b c d"), (3, "q")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in remove_repeats(df, 3).collect()}
    assert got == {1: [(1, 4)], 2: [(1, 4)], 3: []}
    assert remove_repeats(df.limit(0), 3).count() == 0


def test_windows_that_differ_above_40_bits_only(spark):
    # of each two, the hashes of both words agree in the low 40 bits and in the first 3: the bucket of 8
    texts = [f"w{i} q" for i in (6445792, 7958567, 3892991, 7186519, 4007989, 8492694)] + ["r w5 q", "w5 q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, 2).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 2)
