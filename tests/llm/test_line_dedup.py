import random

from tidemark.llm.line_dedup import common_blocks, increasing, patience, remove_common_lines


def order(rows):
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))


def with_blanks(lines, gone):
    """gone and the blank lines whose nearest others on both sides are in it (document ends count as gone)."""
    solid = [k for k, x in enumerate(lines) if x.strip()]
    for k, x in enumerate(lines):
        if not x.strip() and solid:
            before, behind = [s for s in solid if s < k][-1:], [s for s in solid if s > k][:1]
            if all(s in gone for s in before + behind):
                gone.add(k)
    return gone


def brute(rows, least):
    """All pairs: what stands in any earlier row as a run of at least so many bytes.  rows: (id, text) in order of rid."""
    split = [None if t is None else t.split("\n") for _, t in rows]
    full = [[(k, x) for k, x in enumerate(w or []) if x.strip()] for w in split]
    rank = {i: p for p, i in enumerate(order(rows))}
    out = []
    for i, w in enumerate(split):
        if w is None:
            out.append((str(rows[i][0]), 0, 0, None))
            continue
        gone = set()
        mine = full[i]
        for j in range(len(rows)):
            if rank[j] < rank[i]:
                for p in range(len(mine)):
                    for q in range(len(full[j])):
                        m, size = 0, 0
                        while p + m < len(mine) and q + m < len(full[j]) and mine[p + m][1] == full[j][q + m][1]:
                            size += len(mine[p + m][1].encode())
                            m += 1
                        if m and size >= least:
                            gone.update(mine[p + x][0] for x in range(m))
        gone = with_blanks(w, gone)
        out.append((str(rows[i][0]), len(w), len(gone), "\n".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(map(str, out))


def aligned(rows, least):
    """Per row, the solid lines that patience diff with any one earlier row deletes."""
    split = [[] if t is None else [x for x in t.split("\n") if x.strip()] for _, t in rows]
    seen, out = [], {}
    for i in order(rows):
        size = [len(x.encode()) for x in split[i]]
        out[i] = {k for j in seen for p, q in common_blocks(split[j], split[i], size, least) for k in range(p, q)}
        seen.append(i)
    return out


def table(rng):
    pool = [" ".join(rng.choice("ab cde f é".split()) for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", "  ", "\t", " " * 30]
    texts = [None, "", "\n\n", " "]
    while len(texts) < 120:
        base = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        for _ in range(rng.choice([1, 1, 3])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 2)] = [rng.choice(pool) for _ in range(rng.randint(0, 2))]
            texts.append("\n".join(w))
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts)) + [(None, texts[9]), (ids[20], texts[21])]


def result(df, least):
    return sorted(str((str(r.doc_id), r.n_lines, r.n_removed, r.kept_text)) for r in remove_common_lines(df, least).collect())


def test_against_all_pairs(spark):
    rows = table(random.Random(7))
    df = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, b string").coalesce(1)
    for least in (1, 12, 30):
        assert result(df, least) == brute(rows, least)
        pairs = aligned(rows, least)
        lost = {str(r): len(pairs[i]) for i, r in enumerate(rows)}
        got = {str((r.doc_id, r.text)): r.n_removed for r in remove_common_lines(df, least, ["doc_id", "text"]).collect()}
        assert all(got[k] >= n for k, n in lost.items())  # recall against patience diff of all pairs is 1
    assert remove_common_lines(df.limit(0)).count() == 0


def test_alignment_decides(spark, monkeypatch):
    """Without alignment nothing goes, whatever runs are shared; with one pass only, moved blocks stay."""
    import tidemark.llm.line_dedup as module

    a, b, c = (f"{x} line of more than twenty-five bytes" for x in "abc")
    rows = [(1, "\n".join([a, b, c, "1", b, "2", a])), (2, "\n".join([c, a, b])), (3, "\n".join([b, a, "x", a, b]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    removed = lambda: {r.doc_id: r.n_removed for r in remove_common_lines(df, 30).collect()}
    assert removed() == {1: 0, 2: 3, 3: 4}
    once = lambda a, b, size, gone, least: [gone.__setitem__(slice(p, q), True) for p, q in common_blocks(a, b, size, least)]
    with monkeypatch.context() as m:
        m.setattr(module, "deleted", once)
        m.setattr(module, "deleted_run", lambda *a: None)
        assert removed()[2] < 3
    with monkeypatch.context() as m:
        m.setattr(module, "common_blocks", lambda *a: [])
        assert removed() == {1: 0, 2: 0, 3: 0}


def test_blocks_whose_lines_have_other_first_holders(spark):
    a, b = "a line of twenty-five by.", "b line of twenty-five by."
    rows = [(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{b}"), (5, f"{b}\n{a}"), (6, f"x\n{a}\n\n{b}\ny")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in remove_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == (0, rows[2][1]) and got[4] == (2, "") and got[5] == (0, rows[4][1]) and got[6] == (3, "x\ny")


def test_ids_of_other_kinds(spark):
    line = "one line of more than forty bytes stands here"
    rows = [("b", line), ("a", f"{line}\nnew"), (None, line), ("c", line)]
    got = {r.doc_id: r.n_removed for r in remove_common_lines(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, None: 1}


def test_patience():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        m = patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
        ys = rng.sample(range(30), rng.randint(0, 12))
        k = increasing(ys)
        assert all(x < y and ys[x] < ys[y] for x, y in zip(k, k[1:]))
        best = [1] * len(ys)
        for i in range(len(ys)):
            best[i] = 1 + max((best[j] for j in range(i) if ys[j] < ys[i]), default=0)
        assert len(k) == max(best, default=0)
    assert patience(list("abcd"), list("abcd")) == [(i, i) for i in range(4)]
    assert common_blocks(list("xabcy"), list("pabcq"), [9] * 5, 20) == [(1, 4)]
