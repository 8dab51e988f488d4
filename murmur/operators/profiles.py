"""Monte Carlo adjusted profile intervals, and benchmark likelihoods of simple models."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.optimizers import nelder_mead
from murmur.functions.special import lgamma


def _tricube(d: np.ndarray, width: float) -> np.ndarray:
    return np.where(d < width, (1 - (d / width) ** 3) ** 3, 0.0) if width > 0 else (d == 0).astype(float)


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75, degree: int = 2, robust: int = 10) -> np.ndarray:
    """Local polynomial regression with tricube weights; a constant x gives the mean.

    ``robust`` rounds at most weigh the points of a neighbourhood down by the biweight of
    their residuals over six median ones, until the same points are cast out; a fit without
    residuals is left as it is.
    """
    if np.ptp(x) == 0:
        return np.full(len(at), y.mean())
    k = min(len(x), max(int(np.ceil(span * len(x))), degree + 1))
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        near = np.argsort(d, kind="stable")[:k]
        w, design = _tricube(d[near], d[near[-1]] * (1 + 1e-9) + 1e-300), np.vander(x[near] - a, degree + 1, increasing=True)
        solve = lambda weights: np.linalg.lstsq(design * np.sqrt(weights)[:, None], y[near] * np.sqrt(weights), rcond=None)[0]  # noqa: E731, B023
        fit, cast_out = solve(w), None
        for _ in range(robust):
            residual = np.abs(y[near] - design @ fit)
            if (scale := 6 * np.median(residual)) <= 1e-12 * (1 + np.abs(y).max()):
                break
            biweight = (1 - np.minimum((residual / scale) ** 2, 1)) ** 2
            if np.count_nonzero(w * biweight) <= degree:
                break
            before, cast_out = cast_out, biweight < 0.34
            fit = solve(w * biweight)
            if before is not None and np.array_equal(before, cast_out):
                break
        out[i] = fit[0]
    return out


def mcap(x: np.ndarray, loglik: np.ndarray, *, level: float = 0.95, span: float = 0.75, n_grid: int = 1000) -> dict:
    """Smoothed maximum, the cutoff with Monte Carlo error, and the interval."""
    x, loglik = np.asarray(x, float), np.asarray(loglik, float)
    grid = np.linspace(x.min(), x.max(), n_grid)
    smooth = loess(x, loglik, grid, span)
    mle = float(grid[np.argmax(smooth)])
    d = np.abs(x - mle)
    m = max(int(np.trunc(span * len(x))), 3)
    edge = np.sort(d)[min(m, len(d)) - 1]
    w = np.where(d < edge, (1 - (d / edge) ** 3) ** 3, 0.0) if edge > 0 else np.ones(len(d))
    design = np.column_stack([np.ones(len(x)), -x * x, x])
    xtw = design.T * w
    inverse = np.linalg.pinv(xtw @ design)
    c, a, b = inverse @ (xtw @ loglik)
    residual = loglik - design @ np.array([c, a, b])
    free = max(int((w > 0).sum()) - 3, 1)
    cov = inverse * float((w * residual**2).sum() / free)
    var_a, var_b, cov_ab = cov[1, 1], cov[2, 2], cov[1, 2]
    mc2 = (var_b - 2 * b / a * cov_ab + (b / a) ** 2 * var_a) / (4 * a * a)
    stat2 = 1 / (2 * a)
    q = NormalDist().inv_cdf((1 + level) / 2) ** 2
    delta = q * (a * mc2 + 0.5)
    inside = grid[smooth.max() - smooth < delta]
    lo, hi = (float(inside.min()), float(inside.max())) if len(inside) else (None, None)
    return {"mle": mle, "lo": lo, "hi": hi, "delta": float(delta), "se_stat": float(np.sqrt(stat2)) if stat2 > 0 else float("nan"), "se_mc": float(np.sqrt(mc2)) if mc2 > 0 else 0.0, "se_total": float(np.sqrt(stat2 + mc2)) if stat2 + mc2 > 0 else float("nan"), "quadratic_max": float(b / (2 * a)) if a > 0 else mle}


_MCAP = "mle double, lo double, hi double, delta double, se_stat double, se_mc double, se_total double, quadratic_max double"


def profile_intervals(profiles: DataFrame, by: str, *, level: float = 0.95, span: float = 0.75, n_grid: int = 1000) -> DataFrame:
    """One row a profile of (by, parameter, loglik). A profile is some hundred points: a group of bounded size."""
    kind = dict(profiles.dtypes)[by]

    def one(key, frame):
        return pd.DataFrame([{by: key[0]} | mcap(frame.parameter.to_numpy(), frame.loglik.to_numpy(), level=level, span=span, n_grid=n_grid)])

    return profiles.select(by, "parameter", "loglik").groupBy(by).applyInPandas(one, f"{by} {kind}, {_MCAP}")


def local_quadratic(points: DataFrame, by: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """(by..., a, b, c) of weighted least squares y = c - a x^2 + b x: the normal equations as sums, solved by Cramer's rule."""
    w = F.col(weight) if weight else F.lit(1.0)
    u, v, z = -F.col(x) * F.col(x), F.col(x), F.col(y)
    s = {"n": w, "u": w * u, "v": w * v, "uu": w * u * u, "uv": w * u * v, "vv": w * v * v, "z": w * z, "uz": w * u * z, "vz": w * v * z}
    sums = points.groupBy(*by).agg(*[F.sum(e).alias(k) for k, e in s.items()])

    def det(m):
        m = [[F.col(e) for e in row] for row in m]
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    full = [["n", "u", "v"], ["u", "uu", "uv"], ["v", "uv", "vv"]]
    swap = lambda k: [[("z", "uz", "vz")[i] if j == k else full[i][j] for j in range(3)] for i in range(3)]
    whole = det(full)
    return sums.select(*by, (det(swap(1)) / whole).alias("a"), (det(swap(2)) / whole).alias("b"), (det(swap(0)) / whole).alias("c"))


def arma_loglik(y: np.ndarray, p: int = 1, d: int = 0, q: int = 1, *, log1p: bool = False) -> float:
    """The maximised Gaussian loglik of an ARIMA(p, d, q) with mean, by the exact state-space likelihood."""
    jacobian = 0.0
    if log1p:
        jacobian = -float(np.sum(np.log1p(y)))
        y = np.log1p(y)
    y = np.diff(y, d) if d else np.asarray(y, float)
    r = max(p, q + 1)

    def negative(v: np.ndarray) -> float:
        mean, sd, ar, ma = v[0], np.exp(v[1]), _stationary(v[2 : 2 + p]), _stationary(v[2 + p : 2 + p + q])
        t = np.zeros((r, r))
        t[:p, 0] = ar
        t[:-1, 1:] += np.eye(r - 1)
        load = np.concatenate([[1.0], ma, np.zeros(r - 1 - q)])
        noise = np.outer(load, load)
        cov = noise.copy()
        step = t.copy()
        for _ in range(60):  # doubling: the stationary covariance
            more = step @ cov @ step.T
            cov, step = cov + more, step @ step
            if np.abs(more).max() < 1e-12 * max(1.0, np.abs(cov).max()):
                break
        if not np.isfinite(cov).all():
            return 1e12
        a, total, squares = np.zeros(r), 0.0, 0.0
        for one in y - mean:
            f = max(cov[0, 0], 1e-12)
            gap = one - a[0]
            squares += gap * gap / f
            total += np.log(f)
            gain = t @ cov[:, 0] / f
            a = t @ a + gain * gap
            cov = t @ cov @ t.T + noise - np.outer(gain, gain) * f
        n = len(y)
        return float(0.5 * (n * np.log(2 * np.pi) + 2 * n * np.log(sd) + total + squares / sd**2))

    start = np.concatenate([[y.mean(), np.log(y.std() + 1e-9)], np.full(p, 0.3), np.full(q, 0.1)])
    return -nelder_mead(negative, start, 400)[1] + jacobian


def _stationary(raw: np.ndarray) -> np.ndarray:
    """Coefficients inside the stationary region from unbounded values, by partial autocorrelations."""
    out = np.empty(0)
    for x in np.tanh(raw):
        out = np.concatenate([out - x * out[::-1], [x]])
    return out


def negbin_loglik(y: np.ndarray, *, autoregressive: bool = False) -> float:
    """The maximised negative-binomial loglik: independent, or with mean a + b y of the time before."""
    y = np.asarray(y, float)

    def logpmf(v, mu, size):
        return lgamma(v + size) - lgamma(size) - lgamma(v + 1) + size * np.log(size / (size + mu)) + np.where(v > 0, v * np.log(mu / (size + mu)), 0)

    mean, var = max(y.mean(), 1e-3), y.var(ddof=1) if len(y) > 1 else y.mean()
    size = np.clip(mean**2 / max(var - mean, 1e-6), 1e-3, 1e6)
    if not autoregressive:
        f = lambda v: -float(np.sum(logpmf(y, np.exp(v[0]), np.exp(min(v[1], 25)))))
        return -nelder_mead(f, np.log([mean, size]), 400)[1]
    f = lambda v: -float(np.sum(logpmf(y[1:], np.exp(v[0]) + np.exp(v[1]) * y[:-1], np.exp(min(v[2], 25)))))
    return -nelder_mead(f, np.log([mean / 2, 0.5, size]), 400)[1]


def benchmark(series: DataFrame, column: str, kind: str, **settings) -> DataFrame:
    """(unit, loglik) of each series under a simple model; a series is one group, as long as its times."""
    fit = {"arma": arma_loglik, "negbin": negbin_loglik}[kind]

    def one(key, frame):
        return pd.DataFrame({"unit": [key[0]], "loglik": [float(fit(frame.sort_values("time").y.to_numpy(float), **settings))]})

    return series.select("series_id", "time", F.col(column).cast("double").alias("y")).groupBy("series_id").applyInPandas(one, "unit string, loglik double")
