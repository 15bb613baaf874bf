"""Vectorised words and hashes over UTF-8 bytes: no Python object is made for a word."""

from __future__ import annotations

import numpy as np

CHUNK = 2 << 20
#: Odd multipliers of the polynomial hashes.
BASE, GRAM = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def delimiters(codes: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[codes] = True
    return out


#: Words are runs of other bytes than these.
SPACES = delimiters([0x20, *range(0x09, 0x0E)])
NEWLINE = delimiters([0x0A])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, CHUNK + (CHUNK >> 2))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            t = np.full(n, np.uint64(base), np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            _powers[name] = t
    return _powers["up"], _powers["down"]


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, down = _table(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * up[: len(buf)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts])


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the runs of items lo (first) to hi (behind the last), whose own hashes are h."""
    up, down = _table(len(h) + 1)
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * up[: len(h)], out=acc[1:])
    return mix((acc[hi] - acc[lo]) * down[lo])


def words(texts: list[bytes], spaces: np.ndarray = SPACES, fold: bool = False):
    """(hashes, doc of each word, starts, ends in the joined buffer, buffer, start of each text in it).

    The buffer is all texts, each followed by one delimiter.  fold: A-Z count as a-z.
    """
    sep = bytes([int(np.flatnonzero(spaces)[0])])
    joined = sep.join(texts) + sep
    buf = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    values = _FOLDED if fold else _BYTES
    hs, ss, es = [], [], []
    at = 0
    while at < len(buf):
        to = min(len(buf), at + CHUNK)
        while to < len(buf) and not spaces[buf[to - 1]]:  # a chunk ends behind a delimiter
            tail = np.flatnonzero(spaces[buf[to : to + 4096]])
            to = to + int(tail[0]) + 1 if len(tail) else min(len(buf), to + 4096)
        part = buf[at:to]
        inside = ~spaces[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hs.append(_hashes(part, s, e, values))
        ss.append(s + at)
        es.append(e + at)
        at = to
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    e = np.concatenate(es) if es else np.zeros(0, np.int64)
    return h, np.searchsorted(begins, s, side="right") - 1, s, e, joined, begins


def lines(texts: list[bytes]):
    """(hashes, doc of each line, starts, ends, buffer, begins); lines are what stands between newlines, empty ones too."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    h = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # whole lines of about CHUNK bytes
        m = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK)))
        lo, hi = starts[k], ends[m - 1]
        h[k:m] = _hashes(buf[lo:hi], starts[k:m] - lo, ends[k:m] - lo, _BYTES)
        k = m
    return h, np.searchsorted(begins, starts, side="right") - 1, starts, ends, joined, begins


def grams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-word runs that lie within one document, their first word's index)."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size, acc, done, power = 1, h, None, np.uint64(GRAM)
    got, left = 0, n
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done, got = acc, size
                else:
                    m = len(h) - got - size + 1
                    done = done[:m] * power + acc[got : got + m]
                    got += size
            left >>= 1
            if left:
                m = len(h) - 2 * size + 1
                acc = acc[:m] * power + acc[size : size + m]
                power = power * power
                size *= 2
    at = np.flatnonzero(doc[: len(done)] == doc[n - 1 : n - 1 + len(done)])
    return mix(done[at]), at
