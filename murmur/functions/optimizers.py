"""Directions of descent, and a line search. Each optimizer keeps its own state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Optimizer:
    """clip: gradients are clipped element by element; scale: directions get unit length; line_search: Armijo steps."""

    clip: float | None = None
    scale: bool = False
    line_search: bool = False
    c: float = 0.1
    max_halvings: int = 10
    needs_hessian = False
    state: dict = field(default_factory=dict)

    def direction(self, g: np.ndarray, hessian: np.ndarray | None, i: int) -> np.ndarray:
        return -g

    def step(self, x: np.ndarray, g: np.ndarray, hessian: np.ndarray | None, i: int, rate: np.ndarray, objective: Callable | None = None, at: float | None = None) -> np.ndarray:
        if self.clip is not None:
            g = np.clip(g, -self.clip, self.clip)
        d = self.direction(g, hessian, i)
        if self.scale and (n := np.linalg.norm(d)) > 0:
            d = d / n
        self.state["step"] = (moved := self._moved(x, g, d, rate, objective, at)) - x
        return moved

    def _moved(self, x: np.ndarray, g: np.ndarray, d: np.ndarray, rate: np.ndarray, objective: Callable | None, at: float | None) -> np.ndarray:
        if not self.line_search or objective is None:
            return x + rate * d
        eta, slope = float(np.mean(rate)), float(g @ d)
        for _ in range(self.max_halvings):
            if objective(x + eta * d) <= at + eta * self.c * slope:
                break
            eta /= 2
        return x + eta * d


class SGD(Optimizer):
    pass


@dataclass
class Adam(Optimizer):
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8

    def direction(self, g, hessian, i):
        m = self.state["m"] = self.beta1 * self.state.get("m", 0) + (1 - self.beta1) * g
        v = self.state["v"] = self.beta2 * self.state.get("v", 0) + (1 - self.beta2) * g * g
        return -(m / (1 - self.beta1 ** (i + 1))) / (np.sqrt(v / (1 - self.beta2 ** (i + 1))) + self.eps)


@dataclass
class FullMatrixAdam(Adam):
    eps: float = 1e-4

    def direction(self, g, hessian, i):
        m = self.state["m"] = self.beta1 * self.state.get("m", 0) + (1 - self.beta1) * g
        v = self.state["v"] = self.beta2 * self.state.get("v", 0) + (1 - self.beta2) * np.outer(g, g)
        w, q = np.linalg.eigh(v / (1 - self.beta2 ** (i + 1)))
        return -(q * (1 / (np.sqrt(np.maximum(w, 0)) + self.eps))) @ (q.T @ (m / (1 - self.beta1 ** (i + 1))))


class BFGS(Optimizer):
    """Inverse-Hessian updates from the second step on; plain descent before.

    Curvature pairs are of the steps that were taken, with their rate or line search.
    """

    def direction(self, g, hessian, i):
        inverse = self.state.get("inverse", np.eye(len(g)))
        if "g" in self.state:
            s, y = self.state["step"], g - self.state["g"]
            if (sy := float(s @ y)) > 1e-12:
                a = np.eye(len(g)) - np.outer(s, y) / sy
                inverse = a @ inverse @ a.T + np.outer(s, s) / sy
        self.state |= {"inverse": inverse, "g": g}
        return -inverse @ g


class Newton(Optimizer):
    needs_hessian = True

    def direction(self, g, hessian, i):
        return -np.linalg.pinv(hessian) @ g


class WeightedNewton(Newton):
    """Newton with a decaying mixture of this and the former Hessians."""

    def direction(self, g, hessian, i):
        n = i + 1
        weight = n ** np.log(n) / (n + 1) ** np.log(n + 1) if i else 0.0
        mixed = self.state["h"] = weight * self.state.get("h", 0) + (1 - weight) * hessian
        return -np.linalg.pinv(mixed) @ g


OPTIMIZERS = {"SGD": SGD, "Adam": Adam, "FullMatrixAdam": FullMatrixAdam, "BFGS": BFGS, "Newton": Newton, "WeightedNewton": WeightedNewton}


def learning_rates(rates: dict[str, float | list[float]], names: list[str], m: int, decay: Callable[[int], float] | None = None) -> np.ndarray:
    """(m, parameters): a scalar or a schedule for each parameter, times the decay; parameters without a rate stay."""
    out = np.zeros((m, len(names)))
    for j, n in enumerate(names):
        own = np.asarray(rates.get(n, 0.0), float)
        if own.ndim and len(own) != m:
            raise ValueError(f"the schedule of {n} has {len(own)} of {m} entries")
        out[:, j] = own
    return out * np.array([decay(i) for i in range(m)])[:, None] if decay else out


def nelder_mead(f: Callable, x0: np.ndarray, iterations: int = 600, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    n = len(x0)
    points = [np.asarray(x0, float)] + [np.asarray(x0, float) + (0.1 * abs(x0[i]) + 0.05) * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(iterations):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        trial = centre + (centre - points[-1])
        got = f(trial)
        if got < values[0]:
            far = centre + 2 * (centre - points[-1])
            further = f(far)
            trial, got = (far, further) if further < got else (trial, got)
        elif got >= values[-2]:
            near = centre + (0.5 if got < values[-1] else -0.5) * (centre - points[-1])
            inner = f(near)
            if inner >= min(got, values[-1]):
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
                continue
            trial, got = near, inner
        points[-1], values[-1] = trial, got
    i = int(np.argmin(values))
    return points[i], values[i]
