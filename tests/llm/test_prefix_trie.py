import hashlib
import random
import zlib

from tidemark.llm.prefix_trie import conversation_trie


def brute(rows, every):
    convs = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if every else 0
        made[c] = tuple(convs.get(c - c % every, [])[:h] + own[h:]) if every else tuple(own)
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], set()).add(c)
    out = []
    for seq, m in nodes.items():
        sub = [s for s in nodes if s[: len(seq)] == seq]
        ends = ",".join(str(c) for c in sorted(c for c in m if made[c] == seq))
        out.append((
            min(m), len(seq), min(nodes[seq[:-1]]) if seq else None, len(m), sum(len(s) == len(seq) + 1 for s in sub), sum(not any(len(x) == len(s) + 1 and x[:-1] == s for x in nodes) for s in sub),
            sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in sub if s), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def make(rng, n, longest, ids):
    rows = []
    for c in ids:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", "assistant", None]), rng.choice(["é" * rng.randint(0, 3), "ab", None, "same"]) if rng.random() < 0.4 else "same"))
    return rows


def test_against_brute_force(spark):
    rng = random.Random(3)
    for every, longest, ids in ((100, 8, [*range(60), *range(101, 130), 200, 201, 399]), (None, 13, range(40))):
        rows = make(rng, 80, longest, ids)
        df = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(None, 0, "user", "x", 1, 2)], "conv_id long, turn long, role string, text string, c int, key int").repartition(5)
        assert rows_of(conversation_trie(df, every=every)) == brute(rows, every)


def test_a_hot_conversation_and_many_copies(spark):
    long = [(7, t, "user", f"t{t % 3}") for t in range(140)]  # more than half of all rows
    copies = [(c, t, "user", "hello") for c in range(100, 140) for t in range(2)]
    rows = long + copies + [(8, 0, "user", "t0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = rows_of(conversation_trie(df))
    assert len(got) == 143
    ends = hashlib.sha256(",".join(str(c) for c in range(100, 140)).encode()).hexdigest()
    assert (100, 2, 100, 40, 0, 1, 39 * 5, ends) in got
    assert [r for r in got if r[1] == 0] == [(7, 0, None, 42, 2, 2, 2 + 2 * 39 * 5, hashlib.sha256(b"").hexdigest())]


def test_turnless_and_empty(spark):
    df = spark.createDataFrame([(5, None, None, None)], "conv_id long, turn long, role string, text string")
    assert rows_of(conversation_trie(df, every=100)) == brute([(5, None, None, None)], 100)
    assert conversation_trie(df.limit(0), every=100).count() == 0
    assert conversation_trie(df.limit(0)).count() == 0
