"""Natural cubic smoothing splines, for covariates that are to be smooth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def smoothing_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, lam: float = 0.0) -> np.ndarray:
    """Values at ``at`` of the natural cubic spline that minimises squared error + lam * integrated squared curvature.

    lam 0 interpolates; beyond the ends the spline goes on as a line.
    """
    order = np.argsort(x)
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n, h = len(x), np.diff(x)
    if n < 3:
        return np.interp(at, x, y) if n == 1 else y[0] + (y[1] - y[0]) / h[0] * (np.asarray(at) - x[0])
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    bend = np.linalg.solve(r + lam * q.T @ q, q.T @ y)
    g = y - lam * q @ bend
    m = np.concatenate([[0.0], bend, [0.0]])
    at = np.asarray(at, float)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    s, e = at - x[i], x[i + 1] - at
    inside = (g[i] * e + g[i + 1] * s) / h[i] - s * e / 6 * ((1 + s / h[i]) * m[i + 1] + (1 + e / h[i]) * m[i])
    left = (g[1] - g[0]) / h[0] - h[0] / 6 * m[1]
    right = (g[-1] - g[-2]) / h[-1] + h[-1] / 6 * m[-2]
    return np.where(at < x[0], g[0] + left * (at - x[0]), np.where(at > x[-1], g[-1] + right * (at - x[-1]), inside))


def smoothed(points: DataFrame, knots: DataFrame, column: str, *, lam: float = 0.0, shift: float = 0.0) -> DataFrame:
    """(series_id, t, column) of ``points`` (series_id, t): the spline of each series' knots, read ``shift`` earlier. A series is one group."""
    def one(key, left, right):
        if not len(right):
            return pd.DataFrame({"series_id": left.series_id, "t": left.t, column: np.nan})
        return pd.DataFrame({"series_id": left.series_id, "t": left.t, column: smoothing_spline(right.time.to_numpy(), right[column].to_numpy(), left.t.to_numpy() - shift, lam)})

    return points.select("series_id", "t").groupBy("series_id").cogroup(knots.select("series_id", "time", column).groupBy("series_id")).applyInPandas(one, f"series_id string, t double, `{column}` double")
