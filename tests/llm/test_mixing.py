import random
from collections import Counter

import pytest

from tidemark.llm.mixing import mix_sources, mixed_rows


def fill(caps, weights, goal):
    free, target = set(caps), {}
    while free:
        level = (goal - sum(target.values())) / sum(weights[s] for s in free)
        over = [s for s in free if caps[s] <= level * weights[s]]
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = caps[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("kind", ["even", "hot", "small"])
def test_targets_and_words(spark, kind):
    rng = random.Random(kind)
    names = ["b", "a", "Z", "é", "𝔘", "", None][: 2 if kind == "small" else 7]
    rows = []
    for i in range(200):
        s = "a" if kind == "hot" and i % 3 == 0 else rng.choice(names)
        rows.append((i, rng.choice([None, "", " "]) if i % 40 == 0 else " \t".join(["w"] * rng.randint(1, 300)), s, "x"))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place string").repartition(3)
    got = mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(5)).collect()))
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want = fill({s: 2 * n for s, n in size.items()}, weights, 1.5 * sum(size.values()))
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) < 3
    mixed = mixed_rows(df)
    assert mixed.columns == df.columns
    times, want_rows, words = Counter(), Counter(), Counter()
    for r in mixed.collect():
        times[r.doc_id, r.text, r.source] += 1
        words[r.source] += len((r.text or "").split())
    longest = Counter()
    for r in got:
        longest[r.source] = max(longest[r.source], r["size"])
    for k, row in enumerate(rows):
        want_rows[row[:3]] += 1
    assert all(n <= 2 * want_rows[k] for k, n in times.items())  # whole texts, none more than twice
    assert all(abs(words[s] - taken[s]) <= longest[s] / 2 + 1 for s in size)


def test_empty(spark):
    df = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mix_sources(df).collect()] == [(0, 0.0, 0)]
    assert mix_sources(df.limit(0)).count() == 0
    assert mixed_rows(df.limit(0)).count() == 0
