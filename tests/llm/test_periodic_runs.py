import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.periodic_runs import collapse_runs, digests, repeated_tail, runs_of


def brute(ids, least, times=3):
    """Every stretch that a period holds, the smallest period first; a stretch counts for its smallest."""
    n, out = len(ids), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, m, p) for (s, m), p in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 7), st.lists(st.integers(0, 1), max_size=40), st.integers(1, 30), st.sampled_from([3, 7, 24]), st.integers(3, 4))
def test_against_brute_force(a, k, b, m, least, times):
    ids = np.array(a * k + b + a[:3] * m + b[:5] * k, np.int32)
    assert runs_of(ids, least, times) == brute(ids.tolist(), least, times)


def test_long_texts_stay_fast():
    n = 120_000
    assert runs_of(np.zeros(n, np.int32)) == [(0, n, 1)]
    one = np.zeros(2 * n, np.int32)
    one[n] = 1
    assert runs_of(one) == [(0, n, 1), (n + 1, n - 1, 1)]
    assert runs_of(np.arange(n, dtype=np.int32) % 7777) == [(0, n, 7777)]


def test_small_grids_only():
    with pytest.raises(ValueError):
        runs_of(np.zeros(30, np.int32), times=2)


def test_rows(spark):
    texts = {1: "a b " * 20, 2: None, 3: " \n", 4: "x " * 23, 5: "x " * 24 + "y", 6: "p q r " * 9 + "s " + "t " * 30, 7: " ".join(f"w{i}" for i in range(300)), 8: "é\x1fz " * 30, None: "a b " * 20}
    rows = [(i, t, "c", 0) for i, t in texts.items()] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, own int").repartition(3)
    assert collapse_runs(df).columns == ["doc_id", "runs", "own", "n_words", "runs", "top", "kept_text"]
    out = collapse_runs(df, keep=["doc_id", "own"])
    assert out.count() == 18
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.top and tuple(r.top), r.kept_text) for r in out.collect()}
    assert got[1] == got[None] == ([(0, 40, 2)], (0, 40, 2), "a b") and got[2] == got[3] == ([], None, "")
    assert got[4][0] == [] and got[5][0] == [(0, 24, 1)] and got[5][2] == "x y"
    assert got[6] == ([(0, 27, 3), (28, 30, 1)], (28, 30, 1), "p q r s t") and got[7][0] == [] and got[8][0] == [(0, 30, 1)]
    assert collapse_runs(df.limit(0)).count() == 0


def test_query_on_planted_tails(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % (i % 13 + 2)}" for k in range(i % 90))) for i in range(300)] + [(301, None)], "doc_id long, text string")
    out = collapse_runs(df, keep=["doc_id"], planted=True)
    planted = 0
    for r in out.select("doc_id", *digests(out)).collect():
        words = [f"w{(r.doc_id * 7 + k * k) % (r.doc_id % 13 + 2)}" for k in range(r.doc_id % 90)] if r.doc_id != 301 else []
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            planted += 1
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert words == repeated_tail(words, 1)
        runs = brute(words, 24)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 10
