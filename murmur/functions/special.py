"""Special functions that neither Spark SQL nor NumPy has."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.duals import Dual

#: Stirling series of log gamma: B_2k / (2k (2k - 1)), fixed values.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8


def lgamma(x) -> np.ndarray:
    """log |gamma(x)| for x > 0: shifted up until the Stirling series is good to 1e-12; infinite at 0 and below."""
    if isinstance(x, Dual):
        return Dual(lgamma(x.v), digamma(x.v)[..., None] * x.d)
    x = np.asarray(x, float)
    safe = np.where(x > 0, x, 1.0)
    small = safe < _SHIFT
    z = np.where(small, safe + _SHIFT, safe)
    product = np.ones_like(z)
    for i in range(_SHIFT):
        product = product * np.where(small, safe + i, 1.0)
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) - np.log(product)
    for k, b in enumerate(_STIRLING):
        out = out + b / z ** (2 * k + 1)
    return np.where(x > 0, out, np.inf)


def digamma(x) -> np.ndarray:
    """The derivative of log gamma for x > 0."""
    x = np.asarray(x, float)
    z, out = x + _SHIFT, np.zeros_like(x)
    for i in range(_SHIFT):
        out = out - 1 / (x + i)
    return out + np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)


def lgamma_column(x: Column) -> Column:
    """The same as a Column expression."""
    small = x < _SHIFT
    z = F.when(small, x + _SHIFT).otherwise(x)
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + i)
    out = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) - F.when(small, F.log(product)).otherwise(0.0)
    for k, b in enumerate(_STIRLING):
        out = out + b / F.pow(z, F.lit(2 * k + 1))
    return out


_ERFC = np.vectorize(math.erfc, otypes=[float])


def log_ndtr(x) -> np.ndarray:
    """log of the normal distribution function, by its asymptotic series far in the lower tail."""
    x = np.asarray(x, float)
    far = x < -20
    near = np.log(np.maximum(0.5 * _ERFC(-np.where(far, 0, x) / math.sqrt(2)), 1e-320))
    z = np.where(far, x, -20.0)
    series = 1 - 1 / z**2 + 3 / z**4 - 15 / z**6 + 105 / z**8
    return np.where(far, -0.5 * z * z - np.log(-z) - 0.5 * math.log(2 * math.pi) + np.log(series), near)


def log_diff_ndtr(low, high) -> np.ndarray:
    """log(Phi(high) - Phi(low)) in log space, from the tail that holds the interval."""
    low, high = np.broadcast_arrays(np.asarray(low, float), np.asarray(high, float))
    flip = low > 0
    a, b = np.where(flip, -high, low), np.where(flip, -low, high)
    la, lb = np.where(np.isneginf(a), -np.inf, log_ndtr(np.where(np.isneginf(a), -1.0, a))), log_ndtr(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b > a, lb + np.log1p(-np.exp(np.minimum(la - lb, 0.0))), -np.inf)
