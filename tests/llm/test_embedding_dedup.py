
import numpy as np

from tidemark.llm import embedding_dedup
from tidemark.llm.embedding_dedup import Forest, near_vectors, tile_links


def found(x, y, threshold):
    return [(a, b) for i, j in tile_links(x, y, threshold) for a, b in zip(i.tolist(), j.tolist())]


def test_bounds_lose_no_pair(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "STEP", 33)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 64))
    x = np.repeat(base, 8, axis=0) + rng.normal(size=(160, 64)) * 0.2
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    for threshold in (0.9, 0.96, 0.98):
        own, far = found(x, None, threshold), found(x[:70], x[70:], threshold)
        assert len(own) == len(set(own)) and set(own) == set(zip(*np.nonzero(np.triu(cos >= threshold, 1))))
        assert {(a, b + 70) for a, b in far} == {(a, b) for a, b in zip(*np.nonzero(cos >= threshold)) if a < 70 <= b}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 9)
    rng = np.random.default_rng(2)
    rows = []
    for k in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((int(rng.integers(0, 10**6)), [float(np.float32(t)) for t in base + rng.normal(size=16) * 0.14], int(k % 3)))
    rows += [(r[0] + 2_000_000, r[1], r[2]) for r in rows[:9]] * 2
    odd = [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] + [1.0] * 15, 0), (4, [None] + [1.0] * 15, 0), (5, rows[0][1], None), (6, rows[0][1][:8], 0), (7, [], 0), (8, [float("inf")] * 16, 1), (None, rows[0][1], rows[0][2])]
    rows += odd
    df = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "vec_id long, embedding array<float>, label int, rid int").repartition(3)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()))
    fine = [c is not None and bool(v) and all(t is not None and np.isfinite(t) for t in v) and any(v) for _, v, c in rows]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), 10**9), r[0])
    want = sorted((r[0] is None, r[0] or 0, n[i], least.get(root(i)), r[0] is not None and r[0] == least[root(i)]) for i, r in enumerate(rows))
    assert got == want
    assert near_vectors(df.limit(0)).count() == 0


def test_a_dense_label_of_many_tiles(spark, monkeypatch):
    """One label of close vectors: every tile asks all others, in strips, and every pair links."""
    monkeypatch.setattr(embedding_dedup, "TILE", 20)
    monkeypatch.setattr(embedding_dedup, "STRIP", 2)
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(k, [float(t) for t in base + rng.normal(size=32) * 0.01], 0) for k in range(110)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, 109, 0) for k in range(110)]


def test_forest():
    rng = np.random.default_rng(4)
    for n in (1, 5, 300):
        f, up = Forest(n), list(range(n))
        edges = []
        for _ in range(4):
            i, j = rng.integers(0, n, 3000), rng.integers(0, n, 3000)
            keep = (i % 7 == j % 7) & (i != j)
            edges += f.join(i[keep], j[keep])
            for a, b in zip(i[keep].tolist(), j[keep].tolist()):
                ra, rb = up[a], up[b]
                up = [min(ra, rb) if x in (ra, rb) else x for x in up] if ra != rb else up
            assert f.root.tolist() == up
        assert len(edges) == n - len(set(up))


def test_vectors_whose_squares_leave_the_range(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e200, 0.0], 0), (3, [1e-200, 1e-204], 0), (4, [5e-324, 0.0], 0), (5, [0.0, 1.7e308], 0), (6, [0.0, 1.0], 0), (7, [1.0, 1e-3], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (1, 5), 6: (1, 5), 7: (4, 1)}
