"""Rounding, shares, hashed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(part, whole, digits: int = 1) -> Column:
    """100 * part / whole with half-even rounding; an empty whole gives 0."""
    part, whole = col(part).cast("double"), col(whole).cast("double")
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def seeded_order(seed, *keys) -> Column:
    """Reproducible pseudo-random sort key: equal seed and key give the same order on any cluster."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_int(digest, start: int = 1) -> Column:
    """32 bits of a hex digest as a whole number, starting at the 1-based character `start`."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def hash_uniform(digest, start: int = 1) -> Column:
    """A uniform number in [0, 1) from 32 bits of a hex digest."""
    return hash_int(digest, start).cast("double") / F.lit(4294967296.0)


# Cumulative probabilities of the Poisson(1) distribution, P(X <= 0), P(X <= 1), ..., as far as 32 bits tell them from 1.
POISSON1_CDF = tuple(
    p for p in (math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(20)) if 1 - p > 2.0**-33
)


def poisson1(u) -> Column:
    """Poisson(1) weight of a uniform number by inverse CDF (resampling weight of one unit)."""
    u = col(u)
    out = F.lit(0)
    for p in POISSON1_CDF:
        out = out + F.when(u >= F.lit(p), 1).otherwise(0)
    return out.cast("bigint")
