"""N-gram Jaccard self-join by signature trees.

1. Rows with equal shingle sets become classes; one row stands for each.
2. Routing: sets whose Jaccard similarity reaches the threshold differ in at most d
   shingles, d being bounded by their size class; of d + m hash ranges m at least hold
   the same shingles in both.  The content of a range is a signature.  Each set leaves out
   its ranges that hold fewer shingles than its smallest but m - s: of m equal ranges s
   have as many as either's bound asks for.  So linked sets share s signatures or more,
   and never by near-empty ranges alone.  Signatures of few sets give pairs, which stay
   if they share s; one of many sets leads from each to its first.  Components of these
   links within a size class are blocks; no link of that class crosses two.
3. Within a block, signature trees: leaves are sets, inner nodes hold the OR of the
   bitmaps below and the range of sizes.  Two trees (or one with itself) are walked
   together; a pair of nodes goes on only if sizes and the largest possible overlap
   allow the threshold.  Pairs of leaves that stay are compared exactly, unless they
   are connected already.
4. A large block is dealt into tiles.  Each is linked within itself; between tiles only
   bitmaps travel (a sixteenth of the sets), and a walk over two of them names the sets that
   may have links, which then are fetched for that pair.  First every tile meets one of
   them, which joins most of a dense group; then the nodes outside a block's largest
   component, dealt into tiles anew, meet each other and those inside.  Two nodes inside it
   need not meet, so a group of near copies costs a multiple of its size and not its square.
5. The links found span each component; components() joins them.

A class, not a row, takes part from 2 on, and links are never listed as all pairs of a
group; no task holds more than two tiles.  The work within one block is at worst quadratic in
its distinct sets that candidate links connect and true links don't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, Scratch, Union, by_bucket, checkpointed, components, frugal, pack, sorted_batch, swept, texts_of, unpack
from .tokens import grams, mix, words

#: Sets of SIZE shingles in a tile, and up to which a block is small; children of a node.
TILE, SMALL, SIZE, FANOUT = 1024, 512, 1024, 8
#: Sets with one signature up to which all their pairs are counted; MANY is above any count asked for.
FEW, MANY = 32, 1 << 20


def size_classes(largest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each class, in how many shingles linked sets of it and the class below can differ)."""
    starts, differ, lo = [], [], 1
    while len(starts) < 3 or starts[-2] <= largest:
        hi = max(lo, den * lo // num)
        starts.append(lo)
        differ.append((den - num) * 2 * hi // (num + den))
        lo = hi + 1
    return np.array(starts), np.array(differ)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; the whole sequence if it is shorter; none without words."""
    h, doc, *_ = words(texts, fold=True)
    g, at = grams(h, doc, n)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    short = np.diff(first)
    cut = np.searchsorted(doc[at], np.arange(len(texts) + 1)) if len(at) else np.zeros(len(texts) + 1, np.int64)
    out = []
    for i, m in enumerate(short):
        if m >= n:
            out.append(np.unique(g[cut[i] : cut[i + 1]]))
        elif m:
            own = grams(h[first[i] : first[i + 1]], np.zeros(m, np.int64), int(m))[0]
            out.append(mix(own + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ranges_of(d: int) -> tuple[int, int]:
    """(m, s) for sets that differ in at most d shingles."""
    m = 1 + -(-(d + 1) // 4)
    return m, max(1, min(3, m // 3))


def signatures(s: np.ndarray, starts: np.ndarray, differ: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(size class, signatures) of a set for its own size class and the next."""
    c = int(np.searchsorted(starts, len(s), side="right")) - 1
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s), out=sums[1:])
    high = s >> np.uint64(32)
    out = []
    for k in (c, c + 1):
        if d := int(differ[k]):
            m, shared = ranges_of(d)
            n = d + m
            part = (high * np.uint64(n)) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(n + 1).astype(np.uint64))
            held = np.diff(cut)
            some = np.flatnonzero(held >= np.partition(held, m - shared)[m - shared])
            salt = mix(some.astype(np.uint64) + np.uint64((k + 1) << 32))
            out.append((k, mix((sums[cut[some + 1]] - sums[cut[some]]) ^ salt)))
    return out


def width_of(size: float) -> int:
    """Bits of the bitmap of a set of about so many shingles."""
    width = 512
    while width < min(16384, 4 * size):
        width *= 2
    return width


def leaves(sets: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the leaves, their bitmaps, sizes and slack, which is shingles beyond one a bit)."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((sizes, np.array([int(s[0]) for s in sets], np.uint64)))
    bitmap = np.zeros((len(sets), width), bool)
    for row, i in enumerate(order):
        bitmap[row, (sets[i] >> np.uint64(11)) % np.uint64(width)] = True
    bitmap = np.packbits(bitmap, axis=1).view(np.uint64)
    return order, bitmap, sizes[order], sizes[order] - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)


class _Tree:
    """Bitmaps, size ranges and slack of each level, leaves first."""

    def __init__(self, bitmap: np.ndarray, size: np.ndarray, slack: np.ndarray):
        lo = hi = size
        self.levels = [(bitmap, lo, hi, slack)]
        while len(lo) > 1:
            at = np.arange(0, len(lo), FANOUT)
            bitmap = np.bitwise_or.reduceat(bitmap, at, axis=0)
            lo, hi, slack = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at)
            self.levels.append((bitmap, lo, hi, slack))


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which node pairs (i of x, j of y) can hold a link."""
    out = np.zeros(len(i), bool)
    step = max(1, (4 << 20) // x[0].shape[1] // 8)
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        fits = (den * x[2][a] >= num * y[1][b]) & (den * y[2][b] >= num * x[1][a])
        common = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(x[3][a], y[3][b]), np.minimum(x[2][a], y[2][b]))
        out[k : k + step] = fits & ((num + den) * most >= num * (x[1][a] + y[1][b]))
    return out


def _children(i: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(children, index of the parent) of nodes i on a level of n nodes below."""
    c = (i[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
    ok = c < n
    return c[ok], np.repeat(np.arange(len(i)), FANOUT)[ok]


def walk(x: _Tree, y: _Tree | None, num: int, den: int, apart=None) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (i of x, j of y; i < j of x, if y is None) that may be linked, of those that apart (of i and j) lets through."""
    same, y = y is None, x if y is None else y
    tops = len(x.levels), len(y.levels)
    i = j = np.zeros(1, np.int64)
    for level in range(max(tops) - 1, -1, -1):
        if not level:
            keep = i < j if same else np.ones(len(i), bool)
            if apart is not None:
                keep &= apart(i, j)
            i, j = i[keep], j[keep]
        keep = _possible(x.levels[min(level, tops[0] - 1)], y.levels[min(level, tops[1] - 1)], i, j, num, den)
        i, j = i[keep], j[keep]
        if level:
            if level < tops[0]:
                c, p = _children(i, len(x.levels[level - 1][1]))
                i, j = c, j[p]
            if level < tops[1]:
                c, p = _children(j, len(y.levels[level - 1][1]))
                i, j = i[p], c
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
    return i, j


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right, or within left if right is None.

    Indexes of right are counted on from len(left).
    """
    sets = left + (right or [])
    width = width_of(float(np.median([len(s) for s in sets])))
    own, *x = leaves(left, width)
    its, *y = (own,) if right is None else leaves(right, width)
    i, j = walk(_Tree(*x), None if right is None else _Tree(*y), num, den)
    found, seen = [], Union(len(sets))
    first = 0 if right is None else len(left)
    for a, b in zip(own[i].tolist(), (its[j] + first).tolist(), strict=True):
        if seen.root(a) != seen.root(b):
            s, t = sets[a], sets[b]
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            at[at == len(t)] = len(t) - 1
            both = int((t[at] == s).sum())
            if den * both >= num * (len(s) + len(t) - both):
                seen.join(a, b)
                found.append((a, b))
    return found


#: A tile: the leaves in order, with the component that each is known to be in.
_COLUMNS = {"node": np.int64, "label": np.int64, "size": np.int64, "slack": np.int64, "lead": np.uint64, "bits": np.uint64}
_PACKED = ", ".join(f"{c} binary" for c in _COLUMNS)
_LINKS = f"x bigint, y bigint, root bigint, tile int, tiles int, {_PACKED}"


def _typed(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(named)
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, named, strict=True)], names=[n for n, _ in named])


def _tile(row: dict) -> dict[str, np.ndarray]:
    """The arrays of a tile's row; bits with a line for each leaf."""
    t = {c: np.frombuffer(row[c], k) for c, k in _COLUMNS.items()}
    return {**t, "bits": t["bits"].reshape(len(t["node"]), -1)}


def _part(t: dict[str, np.ndarray], of: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(t[c][of]).tobytes() for c in _COLUMNS]


def _within(num: int, den: int, classes: int, starts: np.ndarray):
    """Of a bin of small blocks or a tile of a large one: links, and for a tile one row of its leaves."""

    def run(table: pa.Table) -> pa.Table:
        frugal()
        table = table.sort_by([("root", "ascending"), ("node", "ascending")])
        root, node = table.column("root").to_numpy(), table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        none, rows = [None] * 9, []
        cut = np.concatenate([[0], np.flatnonzero(np.diff(root)) + 1, [len(root)]])
        links = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            links = tree_links(sets[lo:hi], None, num, den) if hi - lo > 1 else []
            rows += [(int(node[lo + p]) // classes, int(node[lo + q]) // classes, *none) for p, q in links]
        tiles = table.column("tiles")[0].as_py()
        if tiles > 1:  # then it is one block
            seen = Union(len(node))
            for p, q in links:
                seen.join(p, q)
            order, bitmap, size, slack = leaves(sets, width_of(starts[int(node[0]) % classes + 1]))
            label = node[[seen.root(i) for i in range(len(node))]] // classes
            t = {"node": node, "label": label, "lead": np.array([s[0] for s in sets], np.uint64)}
            t = {c: v[order] for c, v in t.items()} | {"size": size, "slack": slack, "bits": bitmap}
            rows.append((None, None, int(root[0]), table.column("tile")[0].as_py(), tiles, *_part(t, np.arange(len(node)))))
        return _typed(rows, _LINKS)

    return run


def _asked(num: int, den: int):
    """For a pair of tiles, or one with itself: the nodes that may have links to nodes of other labels there."""

    def run(table: pa.Table) -> pa.Table:
        frugal()
        rows = table.sort_by("pos").to_pylist()
        lo, hi, out = rows[0]["lo"], rows[0]["hi"], []
        if len(rows) == 2 or lo == hi:  # else the hash left one of them empty
            both = [_tile(r) for r in rows]
            x, y = both[0], both[-1]
            if len(np.union1d(x["label"], y["label"])) > 1:
                trees = [_Tree(t["bits"], t["size"], t["slack"]) for t in both]
                i, j = walk(trees[0], trees[1] if lo != hi else None, num, den, lambda i, j: x["label"][i] != y["label"][j])
                out = [(rows[0]["root"], lo, hi, n) for n in np.union1d(x["node"][i], y["node"][j]).tolist()]
        return _typed(out, "root bigint, lo int, hi int, node bigint")

    return run


def _exact(num: int, den: int, classes: int):
    """A spanning forest of the links between the sets fetched for a pair of tiles."""

    def run(table: pa.Table) -> pa.Table:
        frugal()
        table = table.sort_by("node")
        rid = table.column("node").to_numpy() // classes
        links = tree_links([np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()], None, num, den)
        return _typed([(int(rid[a]), int(rid[b])) for a, b in links], "x bigint, y bigint")

    return run


_SPLIT = f"root bigint, pos int, tiles int, rest int, {_PACKED}"


def _divided(table: pa.Table, marks: pa.Table) -> pa.Table:
    """A tile with new labels as the leaves inside the block's largest component (if it is marked), and parts of the tiles of the rest.

    Places 0 to inner - 1 are those of the tiles inside, the rest's follow.
    """
    frugal()
    if not table.num_rows or not marks.num_rows:
        return _typed([], _SPLIT)
    row, marks = table.to_pylist()[0], marks.sort_by("node")
    t, at = _tile(row), np.argsort(np.frombuffer(row["node"], np.int64), kind="stable")
    inside, label, inner, rest = (marks.column(c).to_numpy(zero_copy_only=False) for c in ("inside", "label", "inner", "rest"))
    inner, rest = int(inner[0]), int(rest[0])
    back = np.empty(len(at), np.int64)
    back[at] = np.arange(len(at))
    t["label"], inside = label[back], inside[back]
    out = []
    if inside.any():
        out.append((row["root"], row["tile"], inner, rest, *_part(t, np.flatnonzero(inside))))
    if rest:
        to = mix(t["node"].astype(np.uint64)) % np.uint64(rest) if inner else np.full(len(at), row["tile"])
        for k in np.unique(to[~inside]).tolist():
            out.append((row["root"], inner + int(k), inner, rest, *_part(t, np.flatnonzero(~inside & (to == k)))))
    return _typed(out, _SPLIT)


def _merged(table: pa.Table) -> pa.Table:
    """The parts of one tile as one, its leaves in order."""
    frugal()
    rows = table.to_pylist()
    parts = [_tile(r) for r in rows]
    t = {c: np.concatenate([p[c] for p in parts]) for c in _COLUMNS}
    order = np.lexsort((t["node"], t["size"], t["lead"]))
    return _typed([(*[rows[0][c] for c in ("root", "pos", "tiles", "rest")], *_part(t, order))], _SPLIT)


def _candidates(table: pa.Table) -> pa.Table:
    """For a bucket of signatures: how many each pair of sets shares, of those that few have; links to the first for others."""
    frugal()
    ns = table.column("n").to_pylist()
    h = np.concatenate([unpack(x) for x in table.column("h").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, n).T.copy().view(np.int64).reshape(-1) for x, n in zip(table.column("ids").to_pylist(), ns, strict=True)])
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    held = np.diff(np.append(new, len(h)))
    xs, ys, n = [], [], []
    for size in np.unique(held[held > 1]).tolist():
        first = new[held == size]
        if size <= FEW:
            i, j = np.triu_indices(size, 1)
            x, y = ids[first[:, None] + i].reshape(-1), ids[first[:, None] + j].reshape(-1)
        else:
            x = np.repeat(ids[first], size - 1)
            y = ids[first[:, None] + np.arange(1, size)].reshape(-1)
        some = x != y
        xs.append(x[some]), ys.append(y[some]), n.append(np.full(int(some.sum()), 1 if size <= FEW else MANY, np.int64))
    if not xs:
        return pa.table({c: pa.array([], pa.int64()) for c in ("x", "y", "n")})
    pairs, k = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], axis=1), axis=0, return_inverse=True)
    n = np.bincount(k.reshape(-1), np.concatenate(n), len(pairs)).astype(np.int64)
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["x", "y", "n"])


def _joined(docs: DataFrame, n: int, num: int, den: int, keep: list[str], id: str, text: str) -> tuple[Batches, DataFrame]:
    """The row batches, and of each row: rid, id, n (shingles), component_id and whether it stands for its component."""
    spark = docs.sparkSession
    batches, scratch = Batches(docs, [*keep, id], text, stored=True), Scratch(spark, "sets")
    rows, nb, own = batches.rows, batches.nb, f"c{len(keep)}"

    def sizes(t: pa.Table) -> pa.Table:
        t = sorted_batch(t)
        sets = shingle_sets(texts_of(t), n)
        fp = np.array([mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0] if len(s) else 0 for s in sets], np.uint64)
        return pa.table([t.column("rid"), t.column(own), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp.view(np.int64))], names=["rid", "id", "n", "fp"])

    kind = rows.schema[own].dataType
    all_sizes = scratch.keep(rows.groupBy("b").applyInArrow(sizes, T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", kind), *T._parse_datatype_string("n bigint, fp bigint").fields])))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid"))
    classes = scratch.keep(all_sizes.where("n > 0").groupBy("fp", "n").agg(first.alias("r")).select("fp", "n", F.col("r.id").alias("id"), F.col("r.rid").alias("rid")))
    largest, last = classes.agg(F.max("n"), F.max("rid")).first()
    starts, differ = size_classes(largest or 0, num, den)
    k = len(starts)  # a node is a row in a size class: rid * k + class
    if ((last or 0) + 1) * k >= 1 << 63:
        raise ValueError(f"{k} size classes leave too few bits for the rows' numbers")

    def signed(t: pa.Table, reps: pa.Table) -> pa.Table:
        out = {c: [] for c in ("g", "n", "h", "ids")}
        if reps.num_rows:
            t = t.filter(pa.array(np.isin(t.column("rid").to_numpy(), reps.column("rid").to_numpy())))
            t = sorted_batch(t)
            hs, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for rid, s in zip(t.column("rid").to_pylist(), shingle_sets(texts_of(t), n), strict=True):
                for c, x in signatures(s, starts, differ):
                    hs.append(x)
                    ids.append(np.full(len(x), rid * k + c, np.int64))
            h, who = np.concatenate(hs), np.concatenate(ids)
            for g, part in by_bucket(h, nb):
                for c, v in (("g", g), ("n", len(part)), ("h", pack(h[part])), ("ids", who[part].view(np.uint8).reshape(-1, 8).T.tobytes())):
                    out[c].append(v)
        return pa.table([pa.array(out["g"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["h"], pa.binary()), pa.array(out["ids"], pa.binary())], names=["g", "n", "h", "ids"])

    reps = classes.select(batches.batch_of("rid"), "rid")
    near = rows.groupBy("b").cogroup(reps.groupBy("b")).applyInArrow(signed, "g int, n int, h binary, ids binary").groupBy("g").applyInArrow(_candidates, "x bigint, y bigint, n bigint")
    asked = F.element_at(F.array(*[F.lit(ranges_of(int(d))[1]) for d in differ]), (F.col("x") % k + 1).cast("int"))
    near = near.groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= asked).select("x", "y")
    blocks = components(near)
    swept(spark)
    rid = F.expr(f"node div {k}L").alias("rid")
    weight = F.count("*") * F.greatest(F.lit(1.0), F.max(F.element_at(F.array(*[F.lit(int(x)) for x in starts]), (F.col("node") % k + 2).cast("int"))) / SIZE)  # sets of a block are of one size class
    large = scratch.keep(blocks.groupBy("root").agg(weight.alias("w")).where(F.col("w") > SMALL).select("root", F.greatest(F.lit(2), F.ceil(F.col("w") / TILE)).cast("int").alias("tiles")))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile")
    nodes = blocks.join(large, "root", "left").select("root", "node", F.coalesce("tiles", F.lit(1)).alias("tiles"), rid)
    nodes = nodes.select("root", "node", "tiles", "rid", batches.batch_of("rid"))

    def sent(t: pa.Table, own: pa.Table) -> pa.Table:
        """own's rows, at most one for each node of the batch, each with its set as s in place of the batch."""
        t = sorted_batch(t.filter(pa.array(np.isin(t.column("rid").to_numpy(), own.column("rid").to_numpy()))))
        have = dict(zip(t.column("rid").to_pylist(), (x.tobytes() for x in shingle_sets(texts_of(t), n)), strict=True))
        s = pa.array([have[r] for r in own.column("rid").to_pylist()], pa.binary())
        return own.drop_columns(["b", "rid"]).append_column("s", s)

    sets = rows.groupBy("b").cogroup(nodes.groupBy("b")).applyInArrow(sent, "root bigint, node bigint, tiles int, s binary")
    tiled = F.col("tiles") > 1
    bin = F.when(tiled, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(1, 2 * nb))))
    sets = sets.select("root", "node", "tiles", "s", tile, bin.alias("k"), tiled.alias("large"))
    found = scratch.keep(sets.groupBy("large", "k", "tile").applyInArrow(_within(num, den, k, starts), _LINKS))
    links = found.where("root is null").select("x", "y")

    def between(tiles: DataFrame, others) -> DataFrame:
        """Links between tiles (root, pos, ...) and the tiles of the same root at the places `others`."""
        other = F.col("other")
        pairs = tiles.withColumn("other", F.explode(others)).select("root", F.least("pos", other).alias("lo"), F.greatest("pos", other).alias("hi"), "pos", *_COLUMNS)
        asked = scratch.keep(pairs.groupBy("root", "lo", "hi").applyInArrow(_asked(num, den), "root bigint, lo int, hi int, node bigint"))
        wanted = asked.select("node").distinct().select("node", rid).select("*", batches.batch_of("rid"))
        own = rows.groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(sent, "node bigint, s binary")
        got = asked.join(own, "node")  # a set is made once and meets all pairs of tiles that asked for it here, where nothing is held
        return scratch.keep(got.groupBy("root", "lo", "hi").applyInArrow(_exact(num, den, k), "x bigint, y bigint"))

    joined = None
    if not large.isEmpty():
        swept(spark)
        tiles = found.where("root is not null").withColumn("pos", F.col("tile"))
        hub = F.when(F.col("pos") == 0, F.sequence(F.lit(1), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))
        joined = components(links.unionByName(between(tiles, hub))).toDF("rid", "known")
        marks = nodes.where(tiled).join(joined, "rid", "left").select("root", "node", "tiles", tile, F.coalesce("known", "rid").alias("label"))
        marks = scratch.keep(marks)
        top = marks.groupBy("root", "label").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.max("m").alias("m"), F.sum("m").alias("all"), F.count("*").alias("labels")).where("labels > 1")
        dense = F.col("m") >= TILE
        top = scratch.keep(top.join(large, "root").select("root", F.when(dense, F.col("top")).alias("top"), F.when(dense, F.col("tiles")).otherwise(0).alias("inner"), F.when(dense, F.ceil((F.col("all") - F.col("m")) * F.col("tiles") / F.col("all"))).otherwise(F.col("tiles")).cast("int").alias("rest")))
        marks = marks.join(top, "root").select("root", "tile", "node", "label", F.coalesce(F.col("label") == F.col("top"), F.lit(False)).alias("inside"), "inner", "rest")
        parts = tiles.groupBy("root", "tile").cogroup(marks.groupBy("root", "tile")).applyInArrow(_divided, _SPLIT)
        tiles = parts.groupBy("root", "pos").applyInArrow(_merged, _SPLIT)
        inner, last = F.col("tiles"), F.col("tiles") + F.col("rest") - 1
        links = joined.select(F.col("rid").alias("x"), F.col("known").alias("y")).unionByName(between(tiles, F.when(F.col("pos") < inner, F.sequence(inner, last)).otherwise(F.sequence(F.lit(0), last))))
    joined = components(links).toDF("rid", "root")
    linked = scratch.keep(joined.join(classes, "rid"))
    tops = scratch.keep(linked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid")).alias("r")))  # cut here, a hot root's side of the join can be split
    linked = linked.join(tops, "root").select("fp", "n", F.col("r.id").alias("top"), F.col("r.rid").alias("stand"))
    of = classes.select("fp", "n", F.col("id").alias("own"), F.col("rid").alias("one")).join(linked, ["fp", "n"], "left")
    of = of.select("fp", "n", F.when(F.col("stand").isNull(), F.col("own")).otherwise(F.col("top")).alias("component_id"), F.coalesce("stand", "one").alias("stand"))
    out = all_sizes.join(of, ["fp", "n"], "left")
    none = F.col("n") == 0
    out = checkpointed(out.select("rid", "id", "n", F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), (none | (F.col("rid") == F.col("stand"))).alias("stands")))
    scratch.drop()
    return batches, out


def similarity_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, stands) for every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z as a-z; a row's set holds its distinct
    shingles of n words, or the whole sequence if it is shorter.  Two rows link if
    den * intersection >= num * union.  component_id is the smallest id that links reach
    (ids that are null count last); stands marks one row of each component, that with
    the smallest id.  Null, empty and blank texts have no set and link with nothing:
    their component is their own id, and each of them stands.  Rows with equal ids are
    different rows.  An empty table gives an empty result.
    """
    batches, out = _joined(docs.select(id, text), n, num, den, [], id, text)
    batches.scratch.drop()
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", "stands")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their component, with docs' columns as they were."""
    keep = [c for c in docs.columns if c != text]
    batches, out = _joined(docs, n, num, den, keep, id, text)
    schema = T.StructType([*[batches.rows.schema[f"c{i}"] for i in range(len(keep))], T.StructField("z", T.StringType())])

    def read(t: pa.Table, stands: pa.Table) -> pa.Table:
        t = t.filter(pa.array(np.isin(t.column("rid").to_numpy(), stands.column("rid").to_numpy())))
        z = [s.decode() if ok else None for s, ok in zip(texts_of(t), t.column("z").is_valid().to_pylist(), strict=True)]
        return pa.table([*[t.column(c) for c in schema.names[:-1]], pa.array(z, pa.string())], names=schema.names)

    stands = out.where("stands").select(batches.batch_of("rid"), "rid")
    rest = batches.rows.groupBy("b").cogroup(stands.groupBy("b")).applyInArrow(read, schema)
    return rest.select(*[F.col("z" if c == text else f"c{keep.index(c)}").alias(c) for c in docs.columns])
