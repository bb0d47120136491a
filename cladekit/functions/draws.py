"""Random numbers that depend on a seed, a counter and a row's keys alone, and so are the same in every run, layout and engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS, _SHORT = 13, 8  # hexadecimal digits of a number: 52 and 32 bits


def _digest(seed, counter, keys) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), (F.lit(counter) if isinstance(counter, int) else counter).cast("string"),
                             *[p.cast("string") for p in parts]))


def _fraction(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long") / F.lit(float(16**digits))


def uniform(seed, counter, *keys) -> Column:
    """A number in [0, 1) for each counter and row."""
    return _fraction(_digest(seed, counter, keys), 1, _DIGITS)


def four_uniforms(seed, counter, *keys) -> list[Column]:
    """Four shorter numbers from one digest."""
    digest = _digest(seed, counter, keys)
    return [_fraction(digest, 1 + _SHORT * k, _SHORT) for k in range(4)]


def normal(seed, *keys) -> Column:
    """A standard normal number, from two uniform ones."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, 1, *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, 2, *keys))


def poisson_one() -> list[float]:
    """Cumulative Poisson(1) chances, for the number of times a row is redrawn, until they reach 1."""
    out, term = [math.exp(-1)], math.exp(-1)
    while out[-1] + term / len(out) > out[-1]:
        term /= len(out)
        out.append(out[-1] + term)
    return out


def poisson_count(u: Column) -> Column:
    """The Poisson(1) number at a uniform one: how many cumulative chances it reaches."""
    return sum((F.when(u >= c, 1).otherwise(0) for c in poisson_one()), F.lit(0))
