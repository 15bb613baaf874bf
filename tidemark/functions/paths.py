"""Kernels on the arrays of one block of bars: first touch of barriers, and whether a value lies above a moving median."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np


def doubling(values: np.ndarray, best, longest: int) -> list[np.ndarray]:
    """Tables of best (np.minimum or np.maximum) over values[i : i + 2^k], for 2^k up to `longest`; shorter at the end by what is missing."""
    out = [values]
    while 2 << (len(out) - 1) <= longest and len(out[-1]) > 1 << (len(out) - 1):
        half = 1 << (len(out) - 1)
        out.append(best(out[-1][:-half], out[-1][half:]))
    return out


def first_touch(high: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For each i the first bar from start[i] to end[i] with low <= below[i] or high >= above[i], or end[i] + 1.

    A bisection in tables of minima and maxima: a step of 2^k bars is taken if none of them
    touches, from the largest step on, so that an entry costs the logarithm of its horizon.
    Bars without a price touch nothing.
    """
    at = start.copy()
    longest = int((end - start).max(initial=0)) + 1
    lows = doubling(np.where(np.isnan(low), np.inf, low), np.minimum, longest)
    highs = doubling(np.where(np.isnan(high), -np.inf, high), np.maximum, longest)
    for k in reversed(range(len(lows))):
        fits = np.flatnonzero(at + (1 << k) - 1 <= end)
        i = at[fits]
        free = fits[(lows[k][i] > below[fits]) & (highs[k][i] < above[fits])]
        at[free] += 1 << k
    return at


def above_median(values: np.ndarray, n: int, least: int) -> np.ndarray:
    """Whether each value exceeds the median of the last n values up to it; not if it or all but `least` - 1 of them are missing (NaN).

    A value of a sample lies above its median just if those smaller than it are half of the
    sample or more, so its rank is enough; the sample is kept in order as it slides.
    """
    held: list[float] = []
    recent: deque[float] = deque()
    out = np.zeros(len(values), bool)
    for i, v in enumerate(values.tolist()):
        if len(recent) == n:
            old = recent.popleft()
            if old == old:
                del held[bisect_left(held, old)]
        recent.append(v)
        if v == v:
            insort(held, v)
            out[i] = len(held) >= least and 2 * bisect_left(held, v) >= len(held)
    return out


#: Labels of calm or volatile (1) and of down or up (1).
REGIMES = np.array([["calm_down", "calm_up"], ["volatile_down", "volatile_up"]], object)


def regimes(volatility: np.ndarray, momentum: np.ndarray) -> np.ndarray:
    """volatile or calm, by the median of 720 bars of which 100 are known, up or down; what is unknown counts as calm and down."""
    return REGIMES[above_median(volatility, 720, 100).astype(int), (np.nan_to_num(momentum, nan=-1.0) > 0).astype(int)]
