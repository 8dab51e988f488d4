"""Learning rates and random-walk cooling, as Column expressions of the iteration."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_decay(i: Column, m: int, final: float) -> Column:
    return final + (1 - final) * (1 + F.cos(math.pi * i / m)) / 2


def geometric_decay(i: Column, rate: float) -> Column:
    return F.pow(F.lit(rate), i)


def linear_decay(i: Column, m: int, final: float) -> Column:
    return 1 + (final - 1) * i / max(1, m - 1)


def hyperbolic_decay(i: Column, rate: float) -> Column:
    return 1 / (1 + rate * i)


def cooling_geometric(frac: Column, at_50: float) -> Column:
    """Reaches at_50 after 50 iterations; frac = time step / number of times + iteration."""
    return F.pow(F.lit(at_50), frac / 50)


def cooling_cosine(frac: Column, m: int, final: float = 0.0) -> Column:
    return final + (1 - final) * (1 + F.cos(math.pi * F.least(frac, F.lit(float(m))) / m)) / 2


def cooling_hyperbolic(frac: Column, s: float) -> Column:
    return 1 / (1 + s * frac)
