"""Natural and estimation scale of parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transform:
    """Which parameters are logs, logits, parts of a whole or multiples on the estimation scale; the rest stay."""

    log: tuple[str, ...] = ()
    logit: tuple[str, ...] = ()
    simplex: tuple[tuple[str, ...], ...] = ()
    scaled: tuple[tuple[str, float], ...] = ()
    custom_to: Callable | None = None
    custom_from: Callable | None = None

    def to_est(self, theta: dict) -> dict:
        if self.custom_to:
            return self.custom_to(dict(theta))
        out = {k: np.asarray(v, float) for k, v in theta.items()}
        with np.errstate(divide="ignore"):
            for k in self.log:
                out[k] = np.log(out[k])
            for k in self.logit:
                out[k] = np.log(out[k]) - np.log1p(-out[k])
            for group in self.simplex:
                total = sum(np.asarray(theta[k], float) for k in group)
                for k in group:
                    out[k] = np.log(np.asarray(theta[k], float) / total)
        for k, factor in self.scaled:
            out[k] = out[k] * factor
        return out

    def from_est(self, est: dict) -> dict:
        if self.custom_from:
            return self.custom_from(dict(est))
        out = dict(est)
        for k in self.log:
            out[k] = np.exp(est[k])
        for k in self.logit:
            out[k] = 1 / (1 + np.exp(-est[k]))
        for group in self.simplex:
            top = np.maximum.reduce([np.asarray(est[k], float) for k in group])
            parts = {k: np.exp(est[k] - top) for k in group}
            total = sum(parts.values())
            out |= {k: v / total for k, v in parts.items()}
        for k, factor in self.scaled:
            out[k] = est[k] / factor
        return out

    def log_jacobian(self, est: dict) -> float:
        """log |d natural / d estimation| of the one-to-one parts; a custom transform is differenced."""
        if self.custom_from:
            names = list(est)
            base = np.array([float(est[k]) for k in names])

            def at(v: np.ndarray) -> np.ndarray:
                out = self.custom_from(dict(zip(names, v)))
                return np.array([float(out[k]) for k in names])

            h = 1e-6
            j = np.column_stack([(at(base + h * e) - at(base - h * e)) / (2 * h) for e in np.eye(len(names))])
            return float(np.linalg.slogdet(j)[1])
        total = sum(float(est[k]) for k in self.log) - sum(float(np.log(factor)) for _, factor in self.scaled)
        for k in self.logit:
            p = 1 / (1 + np.exp(-float(est[k])))
            total += float(np.log(p) + np.log1p(-p))
        return total
