"""Random-walk proposals of Markov chains."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class DiagonalWalk:
    """Independent normal steps; parameters without a positive deviation stay."""

    sd: dict[str, float]

    def propose(self, theta: dict[str, float], rng: np.random.Generator) -> dict[str, float]:
        return {k: v + (self.sd[k] * rng.standard_normal() if self.sd.get(k, 0) > 0 else 0.0) for k, v in theta.items()}

    def learn(self, theta: dict[str, float], accepted: bool, i: int) -> None:
        pass


@dataclass
class FullWalk(DiagonalWalk):
    """Normal steps of a full covariance; parameters outside ``names`` stay."""

    sd: dict[str, float] = field(default_factory=dict)
    names: tuple[str, ...] = ()
    covariance: np.ndarray | None = None

    def propose(self, theta, rng):
        step = np.linalg.cholesky(self.covariance) @ rng.standard_normal(len(self.names))
        return theta | {k: theta[k] + s for k, s in zip(self.names, step)}


@dataclass
class AdaptiveWalk(DiagonalWalk):
    """Scale adapted toward an acceptance of 0.234 first, then 2.38^2 / d times the chain's own covariance."""

    scale_start: int = 100
    shape_start: int = 200
    cooling: float = 0.999
    target: float = 0.234
    scale: float = 1.0
    n: int = 0
    mean: np.ndarray | None = None
    scatter: np.ndarray | None = None
    accepted: int = 0

    def _names(self, theta):
        return [k for k in theta if self.sd.get(k, 0) > 0]

    def propose(self, theta, rng):
        names = self._names(theta)
        d = len(names)
        if self.n > 1 and self.accepted >= self.shape_start:
            cov = 2.38**2 / d * self.scatter / (self.n - 1) + 1e-10 * np.eye(d)
        else:
            cov = self.scale**2 * np.diag([self.sd[k] ** 2 for k in names])
        step = np.linalg.cholesky(cov) @ rng.standard_normal(d)
        return theta | {k: theta[k] + s for k, s in zip(names, step)}

    def learn(self, theta, accepted, i):
        x = np.array([theta[k] for k in self._names(theta)])
        self.n += 1
        self.accepted += accepted
        if self.mean is None:
            self.mean, self.scatter = x.copy(), np.zeros((len(x), len(x)))
        else:
            gap = x - self.mean
            self.mean = self.mean + gap / self.n
            self.scatter = self.scatter + np.outer(gap, x - self.mean)
        if i >= self.scale_start and self.accepted < self.shape_start:
            self.scale *= float(np.exp(self.cooling ** (i - self.scale_start) * (self.accepted / self.n - self.target)))
