"""Particle algorithms over one series (or one panel) in NumPy; nothing here knows Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from murmur.functions.duals import Dual, log_sum_exp, stopped, value
from murmur.functions.optimizers import OPTIMIZERS, Optimizer
from murmur.operators.models import Model

#: Log of the density that stands for one that isn't a number.
FLOOR = float(np.log(1e-18))


@dataclass
class Series:
    """Observations of one unit with their integration grid; covariates have an entry a sub-step and one for the end."""

    t0: float
    times: np.ndarray
    nstep: np.ndarray
    dt: np.ndarray
    y: dict[str, np.ndarray]
    covars: dict[str, np.ndarray]

    def covars_at(self, k: int) -> dict[str, float]:
        return {c: v[min(k, len(v) - 1)] for c, v in self.covars.items()}

    def y_at(self, i: int) -> dict[str, float]:
        return {c: v[i] for c, v in self.y.items()}


def systematic(lw: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Indices drawn at (u + m) / J along the cumulated weights."""
    c = np.cumsum(np.exp(lw - lw.max()))
    return np.minimum(np.searchsorted(c / c[-1], (rng.random() + np.arange(len(lw))) / len(lw), side="right"), len(lw) - 1)


def normalised(lw: np.ndarray) -> tuple[np.ndarray, float]:
    """Normalised log weights and the log of their sum; a collapse gives even weights and -inf."""
    lw = np.where(np.isnan(lw), -np.inf, lw)
    top = lw.max()
    if not np.isfinite(top):
        return np.full(len(lw), -np.log(len(lw))), -np.inf
    total = top + np.log(np.exp(lw - top).sum())
    return lw - total, float(total)


def propagate(model: Model, x: dict, theta: dict, s: Series, i: int, k: int, t: float, rng) -> tuple[dict, int]:
    x = x | {a: np.zeros(len(next(iter(x.values())))) for a in model.accumulators}
    for _ in range(int(s.nstep[i])):
        x = model.rproc(x, theta, s.covars_at(k), t, float(s.dt[i]), rng)
        t, k = t + float(s.dt[i]), k + 1
    return x, k


def _gathered(x: dict, idx: np.ndarray) -> dict:
    return {n: v[idx] for n, v in x.items()}


def pfilter(model: Model, theta: dict, s: Series, particles: int, rng, *, thresh: float = 0.0) -> dict:
    """Bootstrap filter: loglik and, for each time, cll, ess, filter_mean and prediction_mean.

    Resampling happens where the range of log weights exceeds log(thresh); 0 always resamples.
    """
    x = model.rinit(theta, s.covars_at(0), s.t0, particles, rng)
    even = np.full(particles, -np.log(particles))
    lw, k, t, out = even, 0, s.t0, {"cll": [], "ess": [], "filter_mean": [], "prediction_mean": []}
    limit = np.log(thresh) if thresh > 0 else -np.inf
    for i, time in enumerate(s.times):
        x, k = propagate(model, x, theta, s, i, k, t, rng)
        t = float(time)
        lw, cll = normalised(lw + model.dmeas(s.y_at(i), x, theta, s.covars_at(k), t))
        w = np.exp(lw)
        out["cll"].append(cll)
        out["ess"].append(float(1 / np.sum(w * w)))
        out["filter_mean"].append({n: float(w @ x[n]) for n in model.states})
        out["prediction_mean"].append({n: float(x[n].mean()) for n in model.states})
        if lw.max() - lw.min() > limit:
            x, lw = _gathered(x, systematic(lw, rng)), even
    return out | {"loglik": float(np.sum(out["cll"]))}


def simulate(model: Model, theta: dict, s: Series, n: int, rng) -> tuple[list[dict], list[dict]]:
    """States at the start and every time, and observations at every time, as arrays over n paths.

    The measurement sees the time that it belongs to, and the next interval starts there.
    """
    x = model.rinit(theta, s.covars_at(0), s.t0, n, rng)
    states, observed, k, t = [dict(x)], [], 0, s.t0
    for i, time in enumerate(s.times):
        x, k = propagate(model, x, theta, s, i, k, t, rng)
        t = float(time)
        states.append(dict(x))
        observed.append(model.rmeas(x, theta, s.covars_at(k), t, rng))
    return states, observed


@dataclass(frozen=True)
class Perturbation:
    """Random-walk deviations; parameters in ``initial`` move at the start alone; cooling(frac) with frac = i / T + m."""

    sigma: dict[str, float]
    initial: tuple[str, ...] = ()
    cooling: Callable[[float], float] = lambda frac: 0.5 ** (frac / 50)


def perturbed_filter(model: Model, est: dict, s: Series, p: Perturbation, m: int, rng, *, thresh: float = 0.0) -> tuple[dict, float, np.ndarray]:
    """One pass of iterated filtering over the swarm ``est`` (estimation scale): the swarm after it, loglik, ancestors."""
    j = len(next(iter(est.values())))

    def moved(est: dict, names, factor: float) -> dict:
        return {n: v + factor * p.sigma[n] * rng.standard_normal(j) if n in names and p.sigma.get(n, 0) > 0 else v for n, v in est.items()}

    start = [n for n in p.sigma if n in p.initial]
    walk = [n for n in p.sigma if n not in p.initial]
    est = moved(est, start, p.cooling(float(m)))
    x = model.rinit(model.transform.from_est(est), s.covars_at(0), s.t0, j, rng)
    even = np.full(j, -np.log(j))
    lw, k, t, total, line = even, 0, s.t0, 0.0, np.arange(j)
    limit = np.log(thresh) if thresh > 0 else -np.inf
    for i, time in enumerate(s.times):
        est = moved(est, walk, p.cooling(i / len(s.times) + m))
        theta = model.transform.from_est(est)
        x, k = propagate(model, x, theta, s, i, k, t, rng)
        t = float(time)
        g = model.dmeas(s.y_at(i), x, theta, s.covars_at(k), t)
        lw, cll = normalised(lw + np.where(np.isnan(g), FLOOR, g))
        total += cll
        if lw.max() - lw.min() > limit:
            idx = systematic(lw, rng)
            x, est, lw, line = _gathered(x, idx), _gathered(est, idx), even, line[idx]
    return est, float(total), line


def _tiled(est: dict, n: int) -> dict:
    return {k: np.full(n, float(v)) for k, v in est.items()}


def _log_mean(x: list[float]) -> float:
    return normalised(np.asarray(x) - np.log(len(x)))[1]


def mif(model: Model, theta: dict, s: Series, particles: int, iterations: int, p: Perturbation, rng, *, thresh: float = 0.0, monitors: int = 0) -> list[dict]:
    """Iterated filtering: iterations + 1 rows of (iteration, loglik, parameters); means are of the estimation scale."""
    est = _tiled(model.transform.to_est(theta), particles)
    rows = [{"iteration": 0, "loglik": float("nan")} | {k: float(v) for k, v in theta.items()}]
    for m in range(iterations):
        before = {k: float(v.mean()) for k, v in est.items()}
        est, loglik, _ = perturbed_filter(model, est, s, p, m, rng, thresh=thresh)
        if monitors:
            at = {k: float(v) for k, v in model.transform.from_est(before).items()}
            loglik = _log_mean([pfilter(model, at, s, particles, rng, thresh=thresh)["loglik"] for _ in range(monitors)])
        mean = model.transform.from_est({k: float(v.mean()) for k, v in est.items()})
        rows.append({"iteration": m + 1, "loglik": loglik} | {k: float(v) for k, v in mean.items()})
    return rows


def panel_mif(model: Model, shared: dict, specific: dict[str, dict], units: dict[str, Series], particles: int, iterations: int, p: Perturbation, rng, *, block: bool = True, thresh: float = 0.0) -> list[dict]:
    """Panel iterated filtering, units in order; the shared swarm passes from unit to unit.

    block keeps the other units' swarms; without it they follow the ancestors of the filtered unit.
    Rows: (iteration, unit or 'shared', loglik, parameters).
    """
    def to_swarms(own: dict) -> dict:
        est = model.transform.to_est(shared | own)
        return {k: np.full(particles, float(v)) for k, v in est.items()}

    swarm = {u: {k: v for k, v in to_swarms(specific[u]).items() if k not in shared} for u in units}
    common = {k: v for k, v in to_swarms(specific[next(iter(units))]).items() if k in shared}
    rows = []

    def report(m: int, logliks: dict[str, float]) -> None:
        total = float(sum(logliks.values())) if m else float("nan")
        for u in units:
            est = {k: float(v.mean()) for k, v in (common | swarm[u]).items()}
            natural = {k: float(v) for k, v in model.transform.from_est(est).items()}
            if u == next(iter(units)):
                rows.append({"iteration": m, "unit": "shared", "loglik": total} | {k: natural[k] for k in shared})
            rows.append({"iteration": m, "unit": u, "loglik": logliks.get(u, float("nan"))} | {k: natural[k] for k in natural if k not in shared})

    report(0, {})
    for m in range(iterations):
        logliks = {}
        for u, s in units.items():
            est, logliks[u], line = perturbed_filter(model, common | swarm[u], s, p, m, rng, thresh=thresh)
            if not block:
                swarm = {v: _gathered(own, line) for v, own in swarm.items()}
            common = {k: est[k] for k in common}
            swarm[u] = {k: est[k] for k in swarm[u]}
        report(m + 1, logliks)
    return rows


def mop(model: Model, est: dict, s: Series, particles: int, alpha: float, rng, *, dpop: bool = False):
    """-loglik / T by off-parameter weights, differentiable where ``est`` holds duals.

    Particles are always resampled by the measurement density at the parameters' values;
    the weight that a particle carries is one in value and holds the derivative. With dpop
    the state ``model.logw`` adds the process's own log density in the same manner.
    """
    theta = model.transform.from_est(est)
    x = model.rinit(theta, s.covars_at(0), s.t0, particles, rng)
    w, k, t, total = np.zeros(particles), 0, s.t0, 0.0
    for i, time in enumerate(s.times):
        x, k = propagate(model, x, theta, s, i, k, t, rng)
        t = float(time)
        w = alpha * w
        if dpop:
            z = x[model.logw]
            w = w + (z - stopped(z))
        g = model.dmeas(s.y_at(i), x, theta, s.covars_at(k), t)
        g = np.where(np.isnan(value(g)), FLOOR, g)
        total = total + log_sum_exp(w + g) - log_sum_exp(w)
        idx = systematic(normalised(value(g))[0], rng)
        x = _gathered(x, idx)
        w = (w + g - stopped(g))[idx]
    return -1.0 * total / len(s.times)


def gradient(model: Model, names: list[str], at: np.ndarray, fixed: dict, s: Series, particles: int, alpha: float, seed: int, *, dpop: bool = False) -> tuple[float, np.ndarray]:
    out = mop(model, fixed | dict(zip(names, Dual.seeds(at))), s, particles, alpha, np.random.default_rng(seed), dpop=dpop)
    return float(out.v), np.nan_to_num(out.d) if dpop else out.d


def train(model: Model, theta: dict, series: dict[str, Series], particles: int, iterations: int, rates: np.ndarray, names: list[str], rng, *, optimizer: str | Optimizer = "Adam", alpha: float = 0.97, final_alpha: float | None = None, dpop: bool = False, specific: tuple[str, ...] = (), units: dict[str, dict] | None = None, monitors: int = 0, thresh: float = 0.0) -> list[dict]:
    """Descent on the mean negative loglik over all series; iterations + 1 rows of (iteration, unit, loglik, parameters).

    A row's loglik is the objective's where its step began; with ``monitors`` it is the log
    mean of so many plain filters at the row's own parameters, the first and last row
    included. ``names`` are the trained parameters. Of several series, parameters in
    ``specific`` have a value for each (``units``), and every series draws its own stream.
    """
    opt = OPTIMIZERS[optimizer]() if isinstance(optimizer, str) else optimizer
    base = {u: {k: float(v) for k, v in model.transform.to_est(theta | (units or {}).get(u, {})).items()} for u in series}
    slots = [(None, n) for n in names if n not in specific] + [(u, n) for u in series for n in names if n in specific]
    first = next(iter(series))
    x = np.array([base[u or first][n] for u, n in slots])
    rate = lambda m: np.array([rates[m][names.index(n)] for _, n in slots])
    length = sum(len(s.times) for s in series.values())

    def placed(x: np.ndarray, u: str) -> tuple[list[int], dict]:
        own = [i for i, (v, _) in enumerate(slots) if v in (None, u)]
        return own, base[u] | {slots[i][1]: x[i] for i in own}

    def evaluate(x: np.ndarray, seed: int, a: float) -> tuple[float, np.ndarray]:
        total, grad = 0.0, np.zeros(len(x))
        for number, (u, s) in enumerate(series.items()):
            own, fixed = placed(x, u)
            v, g = gradient(model, [slots[i][1] for i in own], x[own], fixed, s, particles, a, seed + number, dpop=dpop)
            share = len(s.times) / length
            total += share * v
            grad[own] += share * g
        return total, grad

    def natural(x: np.ndarray, m: int, loglik: float) -> list[dict]:
        rows = []
        if monitors:
            at = {u: {k: float(v) for k, v in model.transform.from_est(placed(x, u)[1]).items()} for u in series}
            loglik = sum(_log_mean([pfilter(model, at[u], s, particles, rng, thresh=thresh)["loglik"] for _ in range(monitors)]) for u, s in series.items())
        for u in series:
            out = {k: float(v) for k, v in model.transform.from_est(placed(x, u)[1]).items()}
            rows.append({"iteration": m, "unit": u, "loglik": loglik} | out)
        return rows

    rows = natural(x, 0, float("nan"))
    for m in range(iterations):
        a = alpha if final_alpha is None else 1 - (1 - alpha) * (final_alpha + (1 - final_alpha) * (1 + np.cos(np.pi * m / iterations)) / 2)
        seed = int(rng.integers(2**62))
        v, g = evaluate(x, seed, a)
        hessian = None
        if opt.needs_hessian:  # differences of the gradient under the same draws
            h = 1e-4
            hessian = np.column_stack([(evaluate(x + h * e, seed, a)[1] - evaluate(x - h * e, seed, a)[1]) / (2 * h) for e in np.eye(len(x))])
            hessian = (hessian + hessian.T) / 2
        x = opt.step(x, g, hessian, m, rate(m), (lambda z: evaluate(z, seed, a)[0]), v)
        rows += natural(x, m + 1, -v * length)
    return rows


def _log_prior(model: Model, est: dict, theta: dict) -> tuple[float, float]:
    """The prior's log density on the estimation scale, and on the natural one."""
    natural = float(model.dprior(theta)) if model.dprior else 0.0
    return natural + model.transform.log_jacobian(est), natural


def pmcmc(model: Model, theta: dict, s: Series, particles: int, iterations: int, proposal, rng, *, thresh: float = 0.0) -> list[dict]:
    """Particle marginal Metropolis-Hastings on the estimation scale; the current likelihood is kept, not estimated anew."""
    est = {k: float(v) for k, v in model.transform.to_est(theta).items()}
    natural = {k: float(v) for k, v in theta.items()}
    loglik = pfilter(model, natural, s, particles, rng, thresh=thresh)["loglik"]
    prior, shown = _log_prior(model, est, natural)
    rows = [{"iteration": 0, "loglik": loglik, "log_prior": shown, "accepted": False} | natural]
    for m in range(iterations):
        trial = proposal.propose(est, rng)
        at = {k: float(v) for k, v in model.transform.from_est(trial).items()}
        new_prior, new_shown = _log_prior(model, trial, at)
        accepted = False
        if np.isfinite(new_prior):
            new = pfilter(model, at, s, particles, rng, thresh=thresh)["loglik"]
            log_ratio = new + new_prior - loglik - prior
            accepted = bool(np.isfinite(log_ratio) and np.log(rng.random()) < log_ratio)
        if accepted:
            est, natural, loglik, prior, shown = trial, at, new, new_prior, new_shown
        proposal.learn(est, accepted, m)
        rows.append({"iteration": m + 1, "loglik": loglik, "log_prior": shown, "accepted": accepted} | natural)
    return rows


def abc(model: Model, theta: dict, s: Series, iterations: int, proposal, probes: dict[str, Callable], scale: dict[str, float], epsilon: float, rng) -> list[dict]:
    """Approximate Bayesian computation by Markov chain: a move needs the prior's ratio and simulated probes near the data's."""
    if set(probes) != set(scale) or min(scale.values()) <= 0:
        raise ValueError("every probe needs a positive scale")
    names = sorted(probes)
    target = np.array([probes[n](s.y) for n in names])
    width = np.array([scale[n] for n in names])

    def distance(at: dict) -> float:
        _, observed = simulate(model, at, s, 1, rng)
        y = {o: np.array([row[o][0] for row in observed]) for o in model.observed}
        return float(np.sum(((target - np.array([probes[n](y) for n in names])) / width) ** 2))

    est = {k: float(v) for k, v in model.transform.to_est(theta).items()}
    natural = {k: float(v) for k, v in theta.items()}
    prior, shown = _log_prior(model, est, natural)
    apart = distance(natural)
    rows = [{"iteration": 0, "distance": apart, "log_prior": shown, "accepted": False} | natural]
    for m in range(iterations):
        trial = proposal.propose(est, rng)
        at = {k: float(v) for k, v in model.transform.from_est(trial).items()}
        new_prior, new_shown = _log_prior(model, trial, at)
        accepted = bool(np.isfinite(new_prior) and np.log(rng.random()) < new_prior - prior)
        if accepted:
            new = distance(at)
            accepted = new < epsilon**2
        if accepted:
            est, natural, prior, shown, apart = trial, at, new_prior, new_shown, new
        proposal.learn(est, accepted, m)
        rows.append({"iteration": m + 1, "distance": apart, "log_prior": shown, "accepted": accepted} | natural)
    return rows


def kalman_loglik(y: np.ndarray, a: float, c: float, q: float, r: float, x0: float, p0: float) -> float:
    """The exact loglik that filters are tested against; q and r are variances."""
    m, v, total = x0, p0, 0.0
    for one in y:
        m, v = a * m, a * a * v + q
        if np.isnan(one):
            continue
        spread = c * c * v + r
        total -= 0.5 * (np.log(2 * np.pi * spread) + (one - c * m) ** 2 / spread)
        gain = c * v / spread
        m, v = m + gain * (one - c * m), (1 - gain * c) * v
    return float(total)
