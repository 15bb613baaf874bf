"""Removal of exactly repeated passages by fixed-block anchors.

Reference blocks are the non-overlapping runs of (window + 1) // 2 words from each
document's start: every window holds a whole one.  All blocks are indexed; every
rolling run of that length, anywhere, probes the index.  A probe that meets a block
at another place is a hit.  Hits are extended: of the windows that hold a hit, those
whose word sequence starts at two places or more are repeats, and runs of such
windows are the maximal exact repeats.

Exchange: a batch of documents sends each bucket of the hash space the hashes of its
distinct probes, 5 bytes each (of windows, 8), with a bit that says whether it is a block here and one
whether it occurs here again; it gets a bit for each back.  Neither a hot passage nor a
group of copies makes pairs: a passage costs one entry a batch.  The 40 bits of a probe
and its bucket only choose the windows that are sent; whether a window is a repeat is
then told by its whole 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import grams, words
from .common import Batches, Scratch, bits, by_bucket, pack, sorted_batch, texts_of, unbits, unpack

_SENT = "g int, b int, n int, h binary, again binary, block binary"
_BACK = "b int, g int, bits binary"


def _distinct(h: np.ndarray):
    """(distinct hashes in order, how often, index of each h among them)."""
    return np.unique(h, return_inverse=True, return_counts=True)


def _whole(h: np.ndarray) -> bytes:
    """All 64 bits of each hash."""
    return h.astype("<u8").tobytes()


def _of_whole(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _sent(b: int, nb: int, u: np.ndarray, again: np.ndarray, block: np.ndarray, packed=pack) -> pa.Table:
    rows = {k: [] for k in ("g", "n", "h", "again", "block")}
    for g, part in by_bucket(u, nb):
        for k, v in (("g", g), ("n", len(part)), ("h", packed(u[part])), ("again", bits(again[part])), ("block", bits(block[part]))):
            rows[k].append(v)
    return pa.table([pa.array(rows["g"], pa.int32()), pa.array([b] * len(rows["g"]), pa.int32()), pa.array(rows["n"], pa.int32()), *[pa.array(rows[k], pa.binary()) for k in ("h", "again", "block")]], names=["g", "b", "n", "h", "again", "block"])


def _matched(table: pa.Table, unpacked=unpack) -> pa.Table:
    """For a bucket: which of each batch's hashes are blocks somewhere and start at two places or more."""
    ns = table.column("n").to_pylist()
    h = np.concatenate([unpacked(x) for x in table.column("h").to_pylist()])
    again = np.concatenate([unbits(x, n) for x, n in zip(table.column("again").to_pylist(), ns, strict=True)])
    block = np.concatenate([unbits(x, n) for x, n in zip(table.column("block").to_pylist(), ns, strict=True)])
    u, k, count = np.unique(h, return_inverse=True, return_counts=True)
    good = (count > 1) | (np.bincount(k, again, len(u)) > 0)
    good &= np.bincount(k, block, len(u)) > 0
    flags = np.split(good[k], np.cumsum(ns)[:-1])
    return pa.table([table.column("b"), table.column("g"), pa.array([bits(f) for f in flags], pa.binary())], names=["b", "g", "bits"])


def _answers(u: np.ndarray, nb: int, back: pa.Table) -> np.ndarray:
    got = dict(zip(back.column("g").to_pylist(), back.column("bits").to_pylist(), strict=True))
    out = np.zeros(len(u), bool)
    for g, part in by_bucket(u, nb):
        if g in got:
            out[part] = unbits(got[g], len(part))
    return out


class _Batch:
    """The words of a batch and its probes."""

    def __init__(self, table: pa.Table, window: int):
        self.table, self.window, self.block = sorted_batch(table), window, (window + 1) // 2
        self.texts = texts_of(self.table)
        self.h, self.doc, *_ = words(self.texts)
        self.first = np.searchsorted(self.doc, np.arange(len(self.texts) + 1))
        g, self.at = grams(self.h, self.doc, self.block)
        self.u, self.k, count = (x.reshape(-1) for x in _distinct(g))
        self.again = count > 1

    def blocks(self) -> np.ndarray:
        aligned = (self.at - self.first[self.doc[self.at]]) % self.block == 0
        return np.bincount(self.k, aligned, len(self.u)) > 0

    def windows(self, hit: np.ndarray):
        """Of the windows that hold a hit: distinct hashes, counts, index of each, first words."""
        is_hit = np.zeros(len(self.h) + 1, np.int64)
        is_hit[self.at[hit[self.k]] + 1] = 1
        held = np.cumsum(is_hit)
        g, at = grams(self.h, self.doc, self.window)
        some = held[at + self.window - self.block + 1] > held[at]
        g, at = g[some], at[some]
        u, k, count = _distinct(g)
        return u, count, k.reshape(-1), at


def remove_repeats(docs: DataFrame, window: int = 35, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' columns named in keep (all but the text, if None), with, for every row:

    n_words, n_removed: words `[^\\x20\\x09-\\x0D]+`, and those of them that lie in a run of
    `window` words of one row whose word sequence also starts elsewhere, in any row;
    spans: the removed runs as (first word, word behind the last); kept_text: the words
    that stay, joined by one space.

    Null and blank texts have no words; texts shorter than a window lose none.  Equal
    rows are different places: copies of a window or more are all removed.  An empty
    table gives an empty result.  Other columns may have any names and nulls.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    batches, scratch = Batches(docs, keep, text), Scratch(docs.sparkSession, "repeats")
    rows, nb = batches.rows, batches.nb

    def probe(t: pa.Table) -> pa.Table:
        x = _Batch(t, window)
        return _sent(t.column("b")[0].as_py(), nb, x.u, x.again, x.blocks())

    def extend(t: pa.Table, hits: pa.Table) -> pa.Table:
        x = _Batch(t, window)
        u, count, *_ = x.windows(_answers(x.u, nb, hits))
        return _sent(t.column("b")[0].as_py(), nb, u, count > 1, np.ones(len(u), bool), _whole)

    hits = scratch.keep(rows.groupBy("b").applyInArrow(probe, _SENT).groupBy("g").applyInArrow(lambda t: _matched(t), _BACK))
    repeats = scratch.keep(rows.groupBy("b").cogroup(hits.groupBy("b")).applyInArrow(extend, _SENT).groupBy("g").applyInArrow(lambda t: _matched(t, _of_whole), _BACK))
    batches.release()
    both = hits.select("b", "g", "bits", F.lit(False).alias("last")).unionByName(repeats.select("b", "g", "bits", F.lit(True).alias("last")))
    out = T.StructType([*rows.select(*[f"c{i}" for i in range(len(keep))]).schema.fields, *T._parse_datatype_string("n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string").fields])

    def cut(t: pa.Table, back: pa.Table) -> pa.Table:
        x = _Batch(t, window)
        last = back.column("last").to_numpy()
        u, _, k, at = x.windows(_answers(x.u, nb, back.filter(pa.array(~last))))
        at = at[_answers(u, nb, back.filter(pa.array(last)))[k]]
        step = np.zeros(len(x.h) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        n_removed, spans, kept = [], [], []
        for i, text in enumerate(x.texts):
            lo, hi = x.first[i], x.first[i + 1]
            g = gone[lo:hi]
            if g.any():
                edge = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                w = text.split()
                kept.append(b" ".join(w[j] for j in np.flatnonzero(~g)).decode())
            else:
                spans.append([])
                kept.append(b" ".join(text.split()).decode())
            n_removed.append(int(g.sum()))
        cols = [x.table.column(f"c{i}") for i in range(len(keep))]
        cols += [pa.array(np.diff(x.first), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())]
        return pa.table(cols, names=[f.name for f in out.fields])

    done = batches.again().groupBy("b").cogroup(both.groupBy("b")).applyInArrow(cut, out)
    return done.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "n_words", "n_removed", "spans", "kept_text")
