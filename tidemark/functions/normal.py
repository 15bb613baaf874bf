"""The standard normal distribution as Spark columns and as scalars."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of G. West's double-precision cumulative normal (2005).
UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
FAR = 7.07106781186547
EULER = 0.5772156649015329


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = x * out + c
    return out


def cdf(z: Column) -> Column:
    x = F.abs(z)
    near = F.exp(-x * x / 2) * _poly(x, UPPER) / _poly(x, LOWER)
    tail = x + 0.65
    for k in (4, 3, 2, 1):
        tail = x + F.lit(float(k)) / tail
    far = F.when(x > 37, 0.0).otherwise(F.exp(-x * x / 2) / tail / 2.506628274631)
    below = F.when(x < FAR, near).otherwise(far)
    return F.when(z > 0, 1 - below).otherwise(below)


def best_of(trials: int) -> float:
    """Expected largest of so many standard normal draws; 0 for one or none."""
    if trials <= 1:
        return 0.0
    n = NormalDist()
    return (1 - EULER) * n.inv_cdf(1 - 1 / trials) + EULER * n.inv_cdf(1 - 1 / (trials * math.e))
