import random
import zlib

import pytest

from tidemark.llm import sharding
from tidemark.llm.sharding import minimax_cuts, shard_rows


def greedy(sizes, capacity):
    n, held = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


def smallest(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if greedy(sizes, mid) <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("ranges,finer", [(4096, 16), (8, 2), (3, 3)])
def test_capacity_is_the_smallest(spark, monkeypatch, ranges, finer):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    monkeypatch.setattr(sharding, "FINER", finer)
    rng = random.Random(ranges)
    for shards in (1, 3, 7):
        sizes = [rng.choice([16, 17, 40, rng.randint(16, 400)]) for _ in range(rng.randint(1, 90))]
        ends, at = [], 0
        for s in sizes:
            ends.append(at := at + s)
        df = spark.createDataFrame([(e,) for e in ends], "P bigint").coalesce(1)
        capacity, cuts = minimax_cuts(df, at, shards)
        assert capacity == smallest(sizes, shards)
        assert cuts[-1] == at and set(cuts) <= set(ends) and len(cuts) <= shards
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity


def test_rows(spark):
    rng = random.Random(1)
    texts = ["hot" * 30] * 60 + [rng.choice(["a", "bb", "é", "", None]) for _ in range(30)] + ["".join(rng.choice("ab é\n") for _ in range(rng.randint(1, 60))) for _ in range(90)]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, "k") for i, t in zip(ids, texts)] + [(None, "hot" * 30, "k"), (None, "lone", "k"), (ids[0], texts[0], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(4)
    got = shard_rows(df, 6).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) if t is not None else (str(i), 16, None) for i, t, _ in rows)
    of, slots, sizes = {}, {}, {}
    text_of = {(str(i), zlib.crc32(t.encode()) if t is not None else None): t for i, t, _ in rows}
    for r in got:
        assert of.setdefault(text_of[str(r.doc_id), r.text_crc32], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    group = {}
    for i, t, _ in rows:
        k = group.setdefault(t, [10**9, 0])
        k[0], k[1] = min(k[0], 10**9 if i is None else i), k[1] + len((t or "").encode()) + 16
    assert max(sizes.values()) <= smallest([s for _, s in sorted(map(tuple, group.values()))], 6)
    assert shard_rows(df.limit(0), 6).count() == 0
