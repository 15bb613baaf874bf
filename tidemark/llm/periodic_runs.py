"""Periodic runs of words in each text, by probes on a harmonic grid.

A run is a stretch of at least `least` words and `times` periods (3 or more) whose words q
apart are identical, q being its smallest period, and that no neighbouring word extends.

For each period p the words at jp, (j+1)p and (j+2)p are compared: any run of three periods
begins early enough before such a place to hold all three, so none is missed, and a text of
n words has about n/1 + n/2 + n/3 + ... = n ln n probes.  They are made as arrays, many
periods at once.  Few places survive; from these the equality of words p apart is followed
to either side by comparing chunks of growing size.  Periods rise.  A place is skipped if
the three words lie in a run found already, or the first two in one whose period divides p:
a run of period p that held them would have that smaller period.  What is found has its
smallest period then, unless it is a run found already.

Texts are independent: there is no shuffle, and a task holds one batch of rows.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, frugal

#: Least words of a run, and least periods in it.
LEAST, TIMES = 24, 3
#: Probes made at once.
_PROBES = 1 << 20


def _probes(ids: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the grid points of periods lo to hi - 1 where three words p apart are equal."""
    p = np.arange(lo, hi)
    n = (len(ids) - 1) // p - 1  # places jp with (j + 2)p < len(ids)
    per = np.repeat(p, n)
    at = per * (np.arange(len(per)) - np.repeat(np.cumsum(n) - n, n))
    k = np.flatnonzero(ids[at] == ids[at + per])
    per, at = per[k], at[k]
    k = np.flatnonzero(ids[at + per] == ids[at + 2 * per])
    per, at = per[k], at[k]
    for step in (1, 2, 3, 5, 8, 13):  # a run's words from its place on equal those p on for p words
        if not len(at):
            break
        k = np.flatnonzero((per <= step) | (ids[np.minimum(at + step, len(ids) - 1)] == ids[np.minimum(at + step + per, len(ids) - 1)]))
        per, at = per[k], at[k]
    return per, at


def _stretch(ids: np.ndarray, p: int, at: int) -> tuple[int, int]:
    """The places around `at` (first, behind the last) whose words equal those p on."""
    n, lo, hi, size = len(ids) - p, at, at + 1, 64
    while hi < n:
        to = min(n, hi + size)
        other = np.flatnonzero(ids[hi:to] != ids[hi + p : to + p])
        if len(other):
            hi += int(other[0])
            break
        hi, size = to, min(4 * size, 1 << 16)
    size = 64
    while lo:
        to = max(0, lo - size)
        other = np.flatnonzero(ids[to:lo] != ids[to + p : lo + p])
        if len(other):
            lo = to + int(other[-1]) + 1
            break
        lo, size = to, min(4 * size, 1 << 16)
    return lo, hi


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, found = len(ids), []
    if times < 3:
        raise ValueError("the grid finds runs of three periods or more")
    top = n // times if n >= least else 0
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # how far found runs reach that hold a word, and the period of the one that does
    lo = 1
    while lo <= top:
        hi, total = lo, 0
        while hi <= top and (hi == lo or total + n // hi <= _PROBES):
            total, hi = total + n // hi, hi + 1
        per, at = _probes(ids, lo, hi)
        lo = hi
        cuts = [*np.flatnonzero(np.diff(per, prepend=0)).tolist(), len(per)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, places = int(per[a]), at[a:b]
            if found:
                far = reach[places]
                places = places[(far <= places + 2 * p) & ((far <= places + p) | (p % period[places] != 0))]
            k = 0
            while k < len(places):
                s, f = _stretch(ids, p, int(places[k]))
                k += int(np.searchsorted(places[k:], f))
                e = f + p
                if e - s >= max(least, times * p) and reach[s] < e:
                    found.append((s, e - s, p))
                    farther = reach[s:e] < e
                    reach[s:e][farther], period[s:e][farther] = e, p
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list, h: int) -> list:
    """The words, or if h ends in 0, with a tail that repeats: from word a on, the p words from there again and again, as h says."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, keep: list[str] | None = None, id: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """docs' columns named in keep (all but the text, if None), with, for every row:

    n_words; runs, array of (start, length, period) by start, then period, words counted from 0;
    top, the run of most periods (ties: smallest start, then period; null without runs);
    kept_text: the words that no run holds behind its first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`.  planted: texts are first given a repeating tail by the
    crc32 of their id, as benchmarks of this operator want it (a null id: none).  A null or
    blank text has no words, no runs and an empty kept_text; runs may overlap, and a word that
    two runs hold goes if either drops it.  Equal rows get equal results; an empty table gives
    an empty one.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    run = T._parse_datatype_string("start bigint, length bigint, period bigint")
    kept = docs.select(*[F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)], F.col(f"`{id}`").cast("string").alias("own"), F.col(f"`{text}`").alias("t"))
    shape = T.StructType([*kept.schema.fields[: len(keep)], *T._parse_datatype_string("n_words bigint").fields, T.StructField("runs", T.ArrayType(run)), T.StructField("top", run), T.StructField("kept_text", T.StringType())])
    fields = pa.struct([(x.name, pa.int64()) for x in run.fields])

    def found(batches):
        for x in batches:
            frugal()
            n, all_runs, top, left = [], [], [], []
            for own, t in zip(x.column(len(keep)).to_pylist(), x.column(len(keep) + 1).to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "replace").split()
                if planted and own is not None:
                    words = repeated_tail(words, zlib.crc32(own.encode()))
                seen: dict = {}
                runs = runs_of(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)), least, times)
                best = None
                stays = np.ones(len(words), bool)
                for r in runs:
                    stays[r[0] + r[2] : r[0] + r[1]] = False
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                n.append(len(words)), all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                top.append(None if best is None else dict(zip(("start", "length", "period"), best, strict=True)))
                left.append(b" ".join(compress(words, stays.tolist())).decode())
            own = [x.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(all_runs, pa.list_(fields)), pa.array(top, fields), pa.array(left, pa.string())], names=shape.names)

    out = kept.mapInArrow(found, shape)
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], "n_words", "runs", "top", "kept_text")


def digests(out: DataFrame) -> list:
    """The columns that name a row's runs and what is left of it by digests."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = out["top"]
    return [
        F.size("runs").cast("bigint").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), F.floor(F.lit(1000) * top["length"] / top["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    ]
