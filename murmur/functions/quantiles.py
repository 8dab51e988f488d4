"""Samplers by inversion: draws as functions of uniforms, so that a stream of hashes replays them.

Invalid parameters give -1 for counts and NaN for continuous draws. A uniform that equals a cumulated
probability, but for rounding, is settled as SQL does: the C library's functions, one term after the other.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable

import numpy as np

from murmur.functions.special import lgamma, log_ndtr


#: A uniform so close to a cumulated probability is a tie, which rounding decides.
_TIE = 1e-9

try:  # NumPy's exp and Python's lgamma differ from the C library's in the last digit
    _lgamma = ctypes.CDLL("libm.so.6").lgamma
    _lgamma.restype, _lgamma.argtypes = ctypes.c_double, [ctypes.c_double]
except (OSError, AttributeError):
    _lgamma = math.lgamma


def _search(u: np.ndarray, log_pmf, top: np.ndarray, term: Callable[..., float], *by: np.ndarray) -> np.ndarray:
    """The smallest k <= top whose cumulated probability reaches u; a pass over k for all draws at once.

    ``term(k, *by)`` is ``log_pmf`` of a single draw, for ties.
    """
    out, total, k = np.full(u.shape, -1, np.int64), np.zeros(u.shape), 0
    open_, tied = np.ones(u.shape, bool), np.zeros(u.shape, bool)
    while open_.any():
        total = total + np.where(open_, np.exp(log_pmf(k)), 0.0)
        tied |= open_ & (np.abs(total - u) < _TIE)
        done = open_ & ((total >= u) | (k >= top))
        out[done] = k
        open_ &= ~done
        k += 1
    for i in zip(*np.nonzero(np.atleast_1d(tied))):
        own = [float(np.atleast_1d(x)[i]) for x in (u, top, *by)]
        np.atleast_1d(out)[i] = _settled(*own[:2], lambda k: term(k, *own[2:]))  # noqa: B023
    return out


def _settled(u: float, top: float, term: Callable[[int], float]) -> int:
    total, k = math.exp(term(0)), 0
    while total < u and k < top:
        k += 1
        total += math.exp(term(k))
    return k


def _poisson_term(k: int, lam: float) -> float:
    return k * math.log(lam) - lam - _lgamma(k + 1) if lam > 0 else 0.0 if k == 0 else -math.inf


def _binomial_term(k: int, n: float, p: float) -> float:
    return _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) if k <= n else -math.inf


def poisson(u, lam) -> np.ndarray:
    """Poisson quantile; the search ends at lam + 10 sqrt(max(lam, 1))."""
    u, lam = np.broadcast_arrays(np.asarray(u, float), np.asarray(lam, float))
    good = np.isfinite(lam) & (lam >= 0) & (u >= 0) & (u <= 1)
    safe = np.where(good, lam, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_lam = np.log(safe)
        out = _search(np.where(good, u, 0.0), lambda k: np.where(safe > 0, k * log_lam - safe - lgamma(k + 1.0), 0.0 if k == 0 else -np.inf), np.floor(safe + 10 * np.sqrt(np.maximum(safe, 1))), _poisson_term, safe)
    return np.where(good, out, -1)


def binomial(u, n, p) -> np.ndarray:
    u, n, p = np.broadcast_arrays(np.asarray(u, float), np.asarray(n, float), np.asarray(p, float))
    good = (n >= 0) & (p >= 0) & (p <= 1) & (u >= 0) & (u <= 1)
    m, q = np.where(good, n, 0.0), np.clip(np.where(good, p, 0.5), 1e-300, 1 - 1e-16)
    pmf = lambda k: np.where(k <= m, lgamma(m + 1) - lgamma(k + 1.0) - lgamma(np.maximum(m - k, 0) + 1) + k * np.log(q) + (m - k) * np.log1p(-q), -np.inf)
    out = np.where(p <= 0, 0, np.where(p >= 1, m, _search(np.where(good, u, 0.0), pmf, m, _binomial_term, m, q)))
    return np.where(good, out, -1).astype(np.int64)


def multinomial(u: np.ndarray, n, p: np.ndarray) -> np.ndarray:
    """Counts by conditional binomials; u has a column for each class but the last, p is normalised."""
    p = np.asarray(p, float) / np.sum(p, axis=-1, keepdims=True)
    left, rest, out = np.asarray(n, float), np.ones(p.shape[:-1]), []
    for j in range(p.shape[-1] - 1):
        share = np.clip(np.divide(p[..., j], rest, out=np.zeros_like(rest), where=rest > 0), 0, 1)
        got = binomial(u[..., j], left, share)
        out.append(got)
        left, rest = left - got, rest - p[..., j]
    return np.stack([*out, left.astype(np.int64)], axis=-1)


def _gamma_cdf(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - lgamma(a))
    term = 1 / a
    total = term.copy()
    for n in range(1, 400):
        term = term * x / (a + n)
        total = total + term
    b = x + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    for i in range(1, 200):
        an = -i * (i - a)
        b = b + 2
        d = 1 / _away(an * d + b)
        c = _away(b + an / c)
        h = h * d * c
    return np.clip(np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h)), 0, 1)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


def gamma(u, shape) -> np.ndarray:
    """Quantile of a unit-scale gamma by bisection on its logarithm."""
    u, a = np.broadcast_arrays(np.asarray(u, float), np.asarray(shape, float))
    good = (a > 0) & np.isfinite(a) & (u >= 0) & (u <= 1)
    b = np.where(good, a, 1.0)
    low, high = np.full(b.shape, -700.0), np.log(b + 40 * np.sqrt(b) + 60)
    for _ in range(80):
        mid = (low + high) / 2
        under = _gamma_cdf(np.exp(mid), b) < u
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(good, np.where(u <= 0, 0.0, np.exp(high)), np.nan)


def negative_binomial(u_gamma, u_poisson, size, *, mu=None, p=None) -> np.ndarray:
    """A gamma mixture of Poissons; exactly one of mu and p."""
    if (mu is None) == (p is None):
        raise ValueError("exactly one of mu and p is needed")
    size = np.asarray(size, float)
    mean = np.asarray(mu, float) if p is None else size * (1 - np.asarray(p, float)) / np.asarray(p, float)
    rate = gamma(u_gamma, size) * mean / size
    return np.where(np.isfinite(rate), poisson(u_poisson, np.where(np.isfinite(rate), rate, 0.0)), -1)


def normal(u) -> np.ndarray:
    """Standard normal quantile by bisection of the log distribution function."""
    u = np.asarray(u, float)
    flip = u > 0.5
    target = np.log(np.where(flip, 1 - u, u))
    low, high = np.full(u.shape, -40.0), np.zeros(u.shape)
    for _ in range(70):
        mid = (low + high) / 2
        under = log_ndtr(mid) < target
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(flip, -high, high)
