import random
import re

from tidemark.llm import decontaminate
from tidemark.llm.decontaminate import clean_rows, contamination, matches

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        if w:
            m = min(window, len(w))
            for k in range(len(w) - m + 1):
                wins.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for m in range(1, window + 1):
            for k in range(len(w) - m + 1):
                if (x := tuple(w[k : k + m])) in wins:
                    hit.update(range(k, k + m))
                    its |= wins[x]
        out.append((str(d), len(w), len(hit), sorted(str(i) for i in its), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def case(rng):
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "A", "a1", "don't", "x-y", "日本"]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 6, 12, 30])))) for i in range(25)] + [(99, None), (7, "W1 w2 zzz")]
    docs = [(0, None), (1, ""), (2, "!?")]
    for d in range(3, 120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.4:
                w = words(rng.choice(items)[1])
                k = rng.randint(0, max(0, len(w) - 3))
                parts.append(" ".join(w[k : k + rng.randint(1, 20)]).upper())
            else:
                parts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))))
        docs.append((d, " ".join(parts)))
    return docs + [docs[5], (None, docs[6][1]), (6, docs[7][1])], items


def test_against_brute_force(spark, monkeypatch):
    for seed, broadcast in ((1, 10**6), (2, 0)):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
        docs, items = case(random.Random(seed))
        d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, words string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in contamination(d, b, 6).collect())
        want = brute(docs, items, 6)
        assert got == want
        clean = clean_rows(d, b, 6)
        assert clean.columns == d.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(x[0] for x in want if not x[4])


def test_proximity_against_brute_force(spark, monkeypatch):
    """Of a window's terms the rarest (first by frequency, then place) is looked up; four fifths of the item's words around it count."""
    rng = random.Random(5)
    docs, items = case(rng)
    docs, items = docs[:60], [x for x in items if words(x[1])]
    window, near = 5, 0.8
    rows = sorted({(d, t) for d, t in docs}, key=str)
    freq = {}
    for _, t in docs:
        for w in words(t):
            freq[w] = freq.get(w, 0) + 1
    want = set()
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        starts = [k for k in range(len(w) - m + 1) if all(freq.get(x, 0) for x in w[k : k + m])]
        for q in {min(range(k, k + m), key=lambda j: (freq[w[j]], j)) for k in starts}:
            around = {w[o] for o in range(max(0, q - window + 1), min(len(w), q + window)) if o != q}
            for d, u in rows:
                v = words(u)
                for p in [k for k, x in enumerate(v) if x == w[q]]:
                    at = [k for k in range(max(0, p - window + 1), min(len(v), p + window)) if k != p and v[k] in around]
                    if around and len({v[k] for k in at}) >= near * len(around):
                        want.add((str(d), i, min([*at, p]), max([*at, p]) + 1))
    for broadcast in (10**6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
        got = matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, near)
        assert {(str(r.id), r.item, r.first, r.last) for r in got.where("not phrase").collect()} == want and len(want) > 20


def test_frequent_words_only(spark):
    """A window of the corpus's most frequent words: its lists are long, their intersection is what occurs."""
    common = "the of and to in a is that it was for on with".split()
    rng = random.Random(3)
    docs = [(d, " ".join(rng.choice(common) for _ in range(400))) for d in range(60)] + [(100, "x " + " ".join(common) + " y"), (101, " ".join(common[1:]))]
    got = {r.doc_id: (r.n_hit, *r["items"]) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(common))], "item_id long, text string")).collect()}
    assert got.pop(100) == (13, "1") and set(got.values()) == {(0,)}


def test_proximity_and_empty(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    d = spark.createDataFrame([(1, "so alpha gamma beta delta zeta epsilon eta it is"), (2, "alpha beta gamma delta epsilon"), (3, "alpha and much else")], "doc_id long, text string")
    assert {(r.id, r.phrase) for r in matches(d, b, 5, near=0.8).collect()} == {(1, False), (2, True)}
    assert {r.id for r in matches(d, b, 5).collect()} == {2}
    assert contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in contamination(d, b.limit(0)).collect())
