"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors that are equal stand as one class with a multiplicity.  The classes of a label
are dealt into tiles.  A unit vector u is stored once as s * q + e with int8 q, and only
q, s and |e| travel; for two of them |u.v - s_u s_v q_u.q_v| <= (1 + |e_u|) |e_v| + |e_u|.

Each pair of tiles of a label is one task that multiplies the codes and names the vectors
of either tile that take part in any pair whose product plus bound reaches the threshold.
Only those are fetched in full precision, and a second task per pair of tiles recomputes
such pairs exactly.  It returns link counts and a spanning forest of its links, never the
pairs themselves.  A task that multiplies holds two tiles; one that answers for a tile holds that
tile and what STRIP partners asked of it, whatever the label's size.

Every pair of tiles of a label is multiplied: the work is quadratic in the distinct
vectors of a label, as exact comparison of unclustered vectors is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, components

#: Classes in a tile, and those of either side that are multiplied at a time.
TILE, STEP = 4096, 1024
#: Partner tiles that one task answers.
STRIP = 8


def quantise(x: np.ndarray):
    """(int8 codes, scale, error norm) of each row of x, made a unit vector first."""
    u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    e = u - q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(np.einsum("ij,ij->i", e, e)) * (1 + 1e-9) + 1e-12


def possible(x: tuple, y: tuple | None, threshold: float):
    """(i, j) of codes x = (q, scale, error) and y (of x with itself, i < j, if y is None) whose cosine may reach the threshold, in blocks."""
    (qx, sx, ex), (qy, sy, ey) = x, x if y is None else y
    wide = np.float32 if qx.shape[1] * 127**2 < 1 << 24 else np.float64  # products of codes are whole numbers: exact
    for a in range(0, len(qx), STEP):
        left = qx[a : a + STEP].astype(wide)
        for b in range(a if y is None else 0, len(qy), STEP):
            approx = (left @ qy[b : b + STEP].astype(wide).T) * sx[a : a + STEP, None] * sy[None, b : b + STEP]
            error = (1 + ex[a : a + STEP])[:, None] * ey[None, b : b + STEP] + ex[a : a + STEP, None]
            near = approx + error + 1e-9 >= threshold
            i, j = np.nonzero(np.triu(near, 1) if y is None and a == b else near)
            yield i + a, j + b


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """(i, j) of the rows of x and y (of x with itself, i < j, if y is None) with cosine >= threshold, in blocks."""
    both = x if y is None else y
    nx, ny = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, both))
    for i, j in possible(quantise(x), None if y is None else quantise(y), threshold):
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            good[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[a], both[b]) / (nx[a] * ny[b]) >= threshold
        yield i[good], j[good]


def _asked(threshold: float):
    """For a pair of tiles of codes: a row for each tile with the rids that may take part in a link."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("tile")
        rows = t.to_pylist()
        both = [(np.frombuffer(r["q"], np.int8).reshape(-1, r["dim"]), np.frombuffer(r["scale"]), np.frombuffer(r["error"])) for r in rows]
        need = [np.zeros(len(c[0]), bool) for c in both]
        for i, j in possible(both[0], both[1] if len(both) > 1 else None, threshold):
            need[0][i] = need[-1][j] = True
        rids = [np.frombuffer(r["rids"], np.int64)[n].tobytes() for r, n in zip(rows, need, strict=True)]
        return pa.table([*[t.column(c) for c in ("grp", "dim", "tile", "i", "j")], pa.array(rids, pa.binary())], names=["grp", "dim", "tile", "i", "j", "rids"]).filter(pa.array([bool(r) for r in rids]))

    return run


def _answered(t: pa.Table, x: pa.Table) -> pa.Table:
    """The asked rows of one tile in full precision."""
    place = {r: k for k, r in enumerate(t.column("rid").to_pylist())}
    v, mult = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1), t.column("mult").to_numpy()
    at = [np.array([place[r] for r in np.frombuffer(d, np.int64).tolist()]) for d in x.column("rids").to_pylist()]
    return pa.table([*[x.column(c) for c in ("grp", "dim", "tile", "i", "j", "rids")], pa.array([mult[k].tobytes() for k in at], pa.binary()), pa.array([v[k].tobytes() for k in at], pa.binary())], names=["grp", "dim", "tile", "i", "j", "rids", "mult", "v"])


class Forest:
    """Components of 0..n-1 under links that come in blocks, most of which join nothing new."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Take in the links (i, j); the pairs of former roots that they join, without cycles.

        Links within a component are dropped as arrays, in parts of growing size, so that of a
        dense block only about one link a node is looked at on its own.
        """
        out, k, size = [], 0, 1024
        while k < len(i):
            a, b = self.root[i[k : k + size]], self.root[j[k : k + size]]
            new = np.flatnonzero(a != b)
            if len(new):
                up = self.root
                for x, y in np.unique(np.stack([a[new], b[new]], axis=1), axis=0).tolist():
                    while up[x] != x:
                        x = int(up[x])
                    while up[y] != y:
                        y = int(up[y])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        out.append((x, y))
                while not np.array_equal(up, up[up]):
                    up = up[up]
                self.root = up
            k, size = k + size, min(2 * size, 1 << 20)
        return out


def _pair(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        out = {"x": [], "y": [], "n": []}
        tiles = t.sort_by("tile").to_pylist()
        both = [(np.frombuffer(r["rids"], np.int64), np.frombuffer(r["mult"], np.int64), np.frombuffer(r["v"], np.float64).reshape(-1, r["dim"])) for r in tiles]
        one, two = both[0], both[-1]
        ids = np.concatenate([one[0], two[0]]) if len(both) > 1 else one[0]
        mult = np.concatenate([one[1], two[1]]) if len(both) > 1 else one[1]
        n, seen = np.zeros(len(ids), np.int64), Forest(len(ids))
        for i, j in tile_links(one[2], two[2] if len(both) > 1 else None, threshold):
            j = j + len(one[0]) if len(both) > 1 else j
            n += np.bincount(i, mult[j], len(ids)).astype(np.int64) + np.bincount(j, mult[i], len(ids)).astype(np.int64)
            for a, b in seen.join(i, j):
                out["x"].append(ids[a]), out["y"].append(ids[b]), out["n"].append(0)
        some = np.flatnonzero(n)
        out["x"] += ids[some].tolist()
        out["y"] += ids[some].tolist()
        out["n"] += n[some].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def _coded(t: pa.Table) -> pa.Table:
    t = t.sort_by("rid")
    q, scale, error = quantise(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1))
    one = t.slice(0, 1)
    return pa.table([*[one.column(c) for c in ("grp", "dim", "tiles", "tile")], *[pa.array([a.tobytes()], pa.binary()) for a in (t.column("rid").to_numpy(), q, scale, error)]], names=["grp", "dim", "tiles", "tile", "rids", "q", "scale", "error"])


def _within_range(v):
    """v, or v times a power of two if the sum of its squares over- or underflows; its directions are the same."""
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    power = F.pow(F.lit(2.0), F.least(F.lit(1000.0), -F.floor(F.log2(F.array_max(F.transform(v, F.abs))))))
    return F.when((square < 1e-290) | (square > 1e300), F.transform(v, lambda x: x * power)).otherwise(v)


def near_vectors(vecs: DataFrame, threshold: float = 0.98, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vecs.

    Rows link if their labels are equal and their vectors' cosine, in double precision,
    is at least the threshold.  n_links counts the other rows linked directly, copies
    one by one; component_id is the smallest id that links reach; kept: id equals it.
    Null labels, null, empty or zero vectors and vectors with null, NaN or infinite
    components link with nothing; neither do vectors of different length.  Rows with equal
    ids are different rows; a null id is never kept.  An empty table gives an empty result.
    """
    v = F.col("v")
    rows = vecs.select(F.col(id).alias("id"), F.col(label).alias("grp"), F.col(vector).cast("array<double>").alias("v")).select(F.monotonically_increasing_id().alias("rid"), "*")
    fine = F.col("grp").isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = checkpointed(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("v", F.when(F.col("fine"), _within_range(v))))
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rid")).alias("r")
    classes = rows.where("fine").groupBy("grp", "v").agg(first, F.count("*").alias("mult"))
    classes = checkpointed(classes.select("grp", "v", F.size("v").alias("dim"), "mult", F.col("r.id").alias("id"), F.col("r.rid").alias("rid")))
    sizes = classes.groupBy("grp", "dim").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = checkpointed(classes.join(sizes, ["grp", "dim"]).select("grp", "dim", "tiles", F.pmod(F.xxhash64("rid"), "tiles").cast("int").alias("tile"), "rid", "mult", "v"))
    kind = T.StructField("grp", vecs.schema[label].dataType)
    shape = lambda more: T.StructType([kind, *T._parse_datatype_string(more).fields])
    codes = dealt.groupBy("grp", "dim", "tile").applyInArrow(_coded, shape("dim int, tiles int, tile int, rids binary, q binary, scale binary, error binary"))
    other = F.col("other")
    pairs = codes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("grp", "dim", "tile", "rids", "q", "scale", "error", F.least("tile", other).alias("i"), F.greatest("tile", other).alias("j"))
    asked = checkpointed(pairs.groupBy("grp", "dim", "i", "j").applyInArrow(_asked(threshold), shape("dim int, tile int, i int, j int, rids binary")))
    strip = lambda: F.floor((F.col("i") + F.col("j") - F.col("tile")) / STRIP).cast("int").alias("strip")  # noqa: E731  # i + j - tile: the partner
    spread = dealt.join(asked.select("grp", "dim", "tile", strip()).distinct(), ["grp", "dim", "tile"])
    asked = asked.select("*", strip())
    told = spread.groupBy("grp", "dim", "tile", "strip").cogroup(asked.groupBy("grp", "dim", "tile", "strip")).applyInArrow(_answered, shape("dim int, tile int, i int, j int, rids binary, mult binary, v binary"))
    found = checkpointed(told.groupBy("grp", "dim", "i", "j").applyInArrow(_pair(threshold), "x bigint, y bigint, n bigint"))
    counts = found.where("x = y").groupBy(F.col("x").alias("rid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("x <> y").select("x", "y")).toDF("rid", "root")
    member = classes.join(counts, "rid", "left").join(roots, "rid", "left")
    member = member.select("grp", "v", "id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("root", "rid").alias("root"))
    tops = member.groupBy("root").agg(F.min("id").alias("top"))
    member = checkpointed(member.join(tops, "root").select("grp", "v", "n", "top"))
    linked = rows.where("fine").join(member, ["grp", "v"]).select("id", "n", "top")
    out = linked.unionByName(rows.where("not fine").select("id", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("top")))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_links"), F.col("top").alias("component_id"), F.coalesce(F.col("id") == F.col("top"), F.lit(False)).alias("kept"))
