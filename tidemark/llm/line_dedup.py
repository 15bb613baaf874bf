"""Removal of repeated lines by pairwise alignment.

Overlapping documents are found through shared runs of lines: the shortest runs that start
or end at a line and have block_bytes bytes; a line of that length is a run of its own.
Every common block of enough bytes is covered by such runs, whatever stands around it, so
two documents that share a block share a run.  A run that stands in two documents or more
leads from every later one to its first holder: a run of n documents makes n - 1 links and
not n * n, and no frequency is cut off.

A document takes its shared runs from the rarest on; unless a run is gone already, the
document is aligned with the run's first holder by patience diff (lines that are unique in
both, their longest increasing sequence, and again between them), and common blocks of
enough bytes are deleted from it, as the later one.  What is left is aligned with the holder
again, until nothing more is found: a block that stands in another order is found so.  A run whose
lines repeat in the holder gives patience diff no unique line; it is aligned with the holder's
places that begin like it, one after the other.  Only aligned blocks go; runs say which
documents to align, and where.  So what goes is what stands in any earlier document, as if
all pairs had been aligned.

Blank lines (no bytes but white space) take no part; one goes if its neighbours do.

Lines travel as 64-bit hashes.  A batch sends each bucket of the hash space its distinct
runs with a count and the first document here; it gets the first holder and the count of
documents in all; then it asks the holders' batches for their lines.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, Scratch, bits, by_bucket, positioned, sorted_batch, texts_of, unbits
from .tokens import SPACES, lines, run_hashes

#: Least bytes of a common block that is deleted.
BLOCK_BYTES = 40
_LAST = (1 << 63) - 1
_SENT = "g int, b int, n int, h binary, count binary, place binary, rid binary"
_BACK = "b int, g int, shared binary, df binary, hb binary, hrid binary"


def increasing(ys: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops, ends, back = [], [], [-1] * len(ys)
    for i, y in enumerate(ys):
        k = bisect_left(tops, y)
        back[i] = ends[k - 1] if k else -1
        tops[k : k + 1] = [y]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences, rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        at: dict = {}
        for i in range(alo, ahi):
            at[a[i]] = -1 if a[i] in at else i
        seen: dict = {}
        for j in range(blo, bhi):
            if b[j] in at:
                seen[b[j]] = -1 if b[j] in seen else j
        both = sorted((at[x], j) for x, j in seen.items() if j >= 0 and at[x] >= 0)
        if not both:
            continue
        p, q = alo, blo
        for k in increasing([j for _, j in both]):
            i, j = both[k]
            todo.append((p, i, q, j))
            out.append((i, j))
            p, q = i + 1, j + 1
        todo.append((p, ahi, q, bhi))
    return sorted(out)


def common_blocks(a: list, b: list, size: list[int], least: int) -> list[tuple[int, int]]:
    """(first, behind the last) lines of b in runs matched to runs of a, of at least so many bytes."""
    out, run = [], []
    for i, j in [*patience(a, b), (-2, -2)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(size[k] for _, k in run) >= least:
                out.append((run[0][1], run[-1][1] + 1))
            run = []
        run.append((i, j))
    return out


def deleted(a: list, b: list, size: list[int], gone: np.ndarray, least: int) -> None:
    """Mark in gone the lines of b in common blocks with a, aligning what is left until nothing more is found."""
    found = True
    while found:
        left = [-1 - k if g else x for k, (x, g) in enumerate(zip(b, gone.tolist(), strict=True))]  # what is gone matches nothing
        found = common_blocks(a, left, size, least)
        for p, q in found:
            gone[p:q] = True


def deleted_run(a: list, b: list, size: list[int], gone: np.ndarray, p: int, q: int, least: int) -> None:
    """Mark in gone the lines p to q - 1 of b where they align, as one run, with a place of a that begins like them."""
    at = -1
    while not gone[p:q].all():
        try:
            at = a.index(b[p], at + 1)
        except ValueError:
            return
        for i, j in common_blocks(a[at : at + q - p], b[p:q], size[p:q], least):
            gone[p + i : p + j] = True


def _ints(values) -> bytes:
    return np.asarray(values, np.int64).tobytes()


def _of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


class _Runs:
    """The lines of a batch that are not blank, flattened, and their runs."""

    def __init__(self, table: pa.Table, least: int):
        self.table = sorted_batch(table)
        self.rid, self.place = self.table.column("rid").to_numpy(), self.table.column("place").to_numpy()
        self.hs, self.size, self.at = ([np.frombuffer(x, t) for x in self.table.column(c).to_pylist()] for c, t in (("h", np.uint64), ("size", np.int32), ("at", np.int32)))
        n = [len(x) for x in self.hs]
        self.begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        h, size = np.concatenate([np.zeros(0, np.uint64), *self.hs]), np.concatenate([np.zeros(0, np.int64), *self.size])
        upto, k = np.concatenate([[0], np.cumsum(size)]), np.arange(len(h))
        to, since = np.searchsorted(upto, upto[:-1] + least), np.searchsorted(upto, upto[1:] - least, side="right") - 1
        ahead, back = to <= len(h), since >= 0
        ahead[ahead] = doc[to[ahead] - 1] == doc[ahead]
        back[back] = doc[since[back]] == doc[back]
        span = np.unique(np.concatenate([k[ahead] * (len(h) + 1) + to[ahead], since[back] * (len(h) + 1) + k[back] + 1]))
        self.lo, self.hi = span // (len(h) + 1), span % (len(h) + 1)
        self.doc = doc[self.lo]
        self.u, self.k = (x.reshape(-1) for x in np.unique(run_hashes(h, self.lo, self.hi), return_inverse=True))

    def send(self, b: int, nb: int) -> pa.Table:
        pair = np.unique(np.stack([self.k, self.doc], axis=1), axis=0) if len(self.k) else np.zeros((0, 2), np.int64)
        count = np.bincount(pair[:, 0], minlength=len(self.u))
        order = np.lexsort((self.rid[pair[:, 1]], self.place[pair[:, 1]], pair[:, 0]))
        first = pair[order[np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)], 1] if len(self.u) else pair[:, 1]
        rows = [(g, b, len(p), self.u[p].tobytes(), _ints(count[p]), _ints(self.place[first[p]]), _ints(self.rid[first[p]])) for g, p in by_bucket(self.u, nb)]
        return _rows(rows, _SENT)

    def links(self, nb: int, back: dict):
        """Per document its (run, holder's batch, holder), the rarest first, for holders other than itself."""
        df, hb, hrid = (np.zeros(len(self.u), np.int64) for _ in range(3))
        for g, p in by_bucket(self.u, nb):
            if g in back:
                shared = p[unbits(back[g][0], len(p))]
                df[shared], hb[shared], hrid[shared] = (_of(x) for x in back[g][1:])
        d, at, r = df[self.k], hb[self.k], hrid[self.k]
        some = np.flatnonzero((d > 1) & (r != self.rid[self.doc]))
        some = some[np.lexsort((self.lo[some], d[some], self.doc[some]))]
        return some, at[some], r[some]


def with_blanks(gone: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Flags of all n lines from those of the lines at `at`: a blank line goes if those before and behind it do."""
    padded = np.concatenate([[True], gone, [True]])
    next = np.searchsorted(at, np.arange(n))
    out = padded[next] & padded[next + 1]
    out[at] = gone
    return out


def _rows(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(named)
    return pa.table([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, named, strict=True)], names=[n for n, _ in named])


def _first_holders(t: pa.Table) -> pa.Table:
    ns, bs = t.column("n").to_pylist(), t.column("b").to_numpy()
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()])
    count, place, rid = (np.concatenate([_of(x) for x in t.column(c).to_pylist()]) for c in ("count", "place", "rid"))
    b = np.repeat(bs, ns).astype(np.int64)
    order = np.lexsort((rid, place, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    first, df = order[new], np.bincount(group, count).astype(np.int64)
    out, at = [], 0
    for n, own, g in zip(ns, bs.tolist(), t.column("g").to_pylist(), strict=True):
        k = group[at : at + n]
        shared = df[k] > 1
        s = k[shared]
        out.append((own, g, bits(shared), _ints(df[s]), _ints(b[first[s]]), _ints(rid[first[s]])))
        at += n
    return _rows(out, _BACK)


def _back(t: pa.Table) -> dict:
    return {g: x for g, *x in zip(*(t.column(c).to_pylist() for c in ("g", "shared", "df", "hb", "hrid")), strict=True)}


def _places(batches: Batches, own: str) -> DataFrame:
    """batches' rows with place, the order of their ids: whole numbers as they are, other kinds by rank."""
    if batches.rows.schema[own].dataType.typeName() in ("byte", "short", "integer", "long"):
        return batches.rows.withColumn("place", F.col(own).cast("bigint"))
    ranked = positioned(batches.table.where(F.col(own).isNotNull()).select("rid", F.col(own).alias("id"), F.lit(1).alias("one")), ["id", "rid"], {"place": "one"})
    return batches.table.join(ranked.select("rid", "place"), "rid", "left")


def remove_common_lines(docs: DataFrame, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' columns named in keep (all but the text, if None), with, for every row:

    n_lines, n_removed: lines (what stands between newlines), and those deleted;
    n_partners: the earlier rows that it was aligned with; kept_text: the lines that stay.

    A line that is not blank goes if it lies in a run of such lines of block_bytes bytes or
    more in all that stands in an earlier row too; a blank line goes if the nearest lines
    around it that are not blank do.  Earlier rows are those with smaller ids (null last), of
    equal ids one of them.  A null text has no lines and stays null; an empty one has one
    empty line.  Copies lose all their lines to the first if these have block_bytes bytes or
    more; within one row nothing is compared.  An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    batches, scratch = Batches(docs, [*keep, id], text), Scratch(docs.sparkSession, "lines")
    nb = batches.nb
    own, cols = f"c{len(keep)}", [f"c{i}" for i in range(len(keep))]

    def hashed(batch):
        for x in batch:
            t = pa.Table.from_batches([x])
            texts = texts_of(t)
            h, doc, s, e, joined, _ = lines(texts)
            solid = np.concatenate([[0], np.cumsum(~SPACES[np.frombuffer(joined, np.uint8)])])
            full = (solid[e] > solid[s]) & t.column("z").is_valid().to_numpy(zero_copy_only=False)[doc]
            line = np.arange(len(h)) - np.searchsorted(doc, doc)
            cut = np.searchsorted(doc[full], np.arange(1, len(texts)))
            parts = [pa.array([p.tobytes() for p in np.split(v[full], cut)], pa.binary()) for v in (h, (e - s).astype(np.int32), line.astype(np.int32))]
            n = pa.array(np.bincount(doc, minlength=len(texts)), pa.int32())
            place = pa.array([_LAST if v is None else v for v in t.column("place").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("b"), x.column("rid"), place, n, *parts], names=["b", "rid", "place", "n", "h", "size", "at"])

    flat = _places(batches, own).select("b", "rid", "place", "z").mapInArrow(hashed, "b int, rid bigint, place bigint, n int, h binary, size binary, at binary").repartition(nb, "b").persist()
    sent = flat.groupBy("b").applyInArrow(lambda t: _Runs(t, block_bytes).send(t.column("b")[0].as_py(), nb), _SENT)
    back = scratch.keep(sent.groupBy("g").applyInArrow(_first_holders, _BACK))
    batches.release()

    def ask(t: pa.Table, x: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _rows([], "b int, rid bigint, asks int")
        _, hb, hrid = _Runs(t, block_bytes).links(nb, _back(x))
        want = np.unique(np.stack([hb, hrid], axis=1), axis=0)
        return _rows([(int(b), int(r), t.column("b")[0].as_py()) for b, r in want], "b int, rid bigint, asks int")

    def answer(t: pa.Table, x: pa.Table) -> pa.Table:
        have = dict(zip(t.column("rid").to_pylist(), t.column("h").to_pylist(), strict=True))
        return _rows([(b, r, have[r]) for r, b in zip(x.column("rid").to_pylist(), x.column("asks").to_pylist(), strict=True)], "b int, hold bigint, h binary")

    asked = flat.groupBy("b").cogroup(back.groupBy("b")).applyInArrow(ask, "b int, rid bigint, asks int")
    held = flat.groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(answer, "b int, hold bigint, h binary")
    none = F.lit(None)
    told = held.select("b", "hold", "h", none.cast("int").alias("g"), *[none.cast("binary").alias(c) for c in ("shared", "df", "hb", "hrid")]).unionByName(
        back.select("b", none.cast("bigint").alias("hold"), none.cast("binary").alias("h"), "g", "shared", "df", "hb", "hrid")
    )

    def align(t: pa.Table, x: pa.Table) -> pa.Table:
        schema = "b int, rid bigint, partners int, gone binary"
        if not t.num_rows:
            return _rows([], schema)
        own, other = _Runs(t, block_bytes), x.filter(x.column("hold").is_valid())
        have = {r: np.frombuffer(h, np.uint64).tolist() for r, h in zip(other.column("hold").to_pylist(), other.column("h").to_pylist(), strict=True)}
        run, _, hrid = own.links(nb, _back(x.filter(x.column("hold").is_null())))
        doc, lo, hi, total = own.doc[run], own.lo[run], own.hi[run], own.table.column("n").to_pylist()
        out, b = [], t.column("b")[0].as_py()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]]) if len(doc) else [0]
        for first, behind in zip(cut[:-1], cut[1:], strict=True):
            d = int(doc[first])
            h, size = own.hs[d].tolist(), own.size[d].tolist()
            gone, met = np.zeros(len(h), bool), set()
            start = int(own.begin[d])
            for p, q, r in zip((lo[first:behind] - start).tolist(), (hi[first:behind] - start).tolist(), hrid[first:behind].tolist(), strict=True):
                if not gone[p:q].all():
                    if r not in met:
                        met.add(r)
                        deleted(have[r], h, size, gone, block_bytes)
                    deleted_run(have[r], h, size, gone, p, q, block_bytes)
            out.append((b, int(own.rid[d]), len(met), bits(with_blanks(gone, own.at[d], total[d]))))
        return _rows(out, schema)

    found = scratch.keep(flat.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(align, "b int, rid bigint, partners int, gone binary"))
    flat.unpersist()
    table = batches.again()
    shape = T.StructType([*table.select(*cols).schema.fields, *T._parse_datatype_string("n_lines bigint, n_removed bigint, n_partners int, kept_text string").fields])

    def cut(t: pa.Table, x: pa.Table) -> pa.Table:
        t = sorted_batch(t)
        gone = {r: (p, g) for r, p, g in zip(x.column("rid").to_pylist(), x.column("partners").to_pylist(), x.column("gone").to_pylist(), strict=True)}
        n, removed, partners, kept = [], [], [], []
        for r, text, ok in zip(t.column("rid").to_pylist(), texts_of(t), t.column("z").is_valid().to_pylist(), strict=True):
            p, g = gone.get(r, (0, None))
            lost = 0
            n.append(text.count(b"\n") + 1 if ok else 0)
            if g is not None:
                flags = unbits(g, n[-1])
                lost = int(flags.sum())
                text = b"\n".join(x for x, f in zip(text.split(b"\n"), flags.tolist(), strict=True) if not f)
            removed.append(lost), partners.append(p), kept.append(text.decode() if ok else None)
        return pa.table([*[t.column(c) for c in cols], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(partners, pa.int32()), pa.array(kept, pa.string())], names=[f.name for f in shape.fields])

    out = table.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(cut, shape)
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "n_lines", "n_removed", "n_partners", "kept_text")
