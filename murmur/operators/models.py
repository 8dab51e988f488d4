"""Process models: NumPy functions over a swarm, bound by name and tried on the driver.

A model function gets and returns dictionaries of arrays, one entry a particle, so the
same function serves one parameter set (scalars) and a swarm of them (arrays).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions.duals import value
from murmur.functions.special import lgamma, log_diff_ndtr
from murmur.functions.transforms import Transform

State = dict[str, np.ndarray]


@dataclass(frozen=True)
class Model:
    """rinit(theta, covars, t, J, rng); rproc(x, theta, covars, t, dt, rng); dmeas(y, x, theta, covars, t); rmeas(x, theta, covars, t, rng); dprior(theta)."""

    name: str
    states: tuple[str, ...]
    observed: tuple[str, ...]
    parameters: tuple[str, ...]
    rinit: Callable
    rproc: Callable
    dmeas: Callable
    rmeas: Callable | None = None
    dprior: Callable | None = None
    accumulators: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    transform: Transform = field(default_factory=Transform)
    logw: str | None = None

    def tried(self, theta: dict[str, float], n: int = 3) -> Model:
        """Runs every function once on dummies, so that mistakes show on the driver."""
        if missing := set(self.parameters) - set(theta):
            raise KeyError(f"parameters without a value: {sorted(missing)}")
        rng = np.random.default_rng(0)
        covars = {c: 1.0 for c in self.covariates}
        x = self.rinit(theta, covars, 0.0, n, rng)
        if set(x) != set(self.states):
            raise ValueError(f"rinit of {self.name} gives {sorted(x)}, not {sorted(self.states)}")
        x = self.rproc(x, theta, covars, 0.0, 1.0, rng)
        if set(x) != set(self.states) or any(np.shape(v) != (n,) for v in x.values()):
            raise ValueError(f"rproc of {self.name} must return an array of one entry a particle for each state")
        y = self.rmeas(x, theta, covars, 0.0, rng) if self.rmeas else {o: np.ones(n) for o in self.observed}
        if set(y) != set(self.observed):
            raise ValueError(f"rmeas of {self.name} gives {sorted(y)}, not {sorted(self.observed)}")
        density = self.dmeas({k: float(v[0]) for k, v in y.items()}, x, theta, covars, 0.0)
        if np.shape(density) != (n,):
            raise ValueError(f"dmeas of {self.name} must return one log density a particle")
        return self

    def with_functions(self, **functions) -> Model:
        return replace(self, **functions)


def euler_exit_probabilities(rates: list[Column], dt: Column) -> list[Column]:
    """Probabilities of leaving by each of competing rates within dt, and of staying, as Columns."""
    total = sum(rates[1:], rates[0])
    gone = 1 - F.exp(-total * dt)
    return [*[F.when(total == 0, 0.0).otherwise(gone * r / total) for r in rates], F.exp(-total * dt)]


def exit_probabilities(rates: list[np.ndarray], dt: float) -> list[np.ndarray]:
    total = sum(np.asarray(r, float) for r in rates)
    share = np.divide(-np.expm1(-total * dt), total, out=np.zeros_like(total), where=total > 0)
    return [np.asarray(r) * share for r in rates]


def draw_exits(n: np.ndarray, rates: list[np.ndarray], dt: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Euler-multinomial: how many of n leave by each rate, by conditional binomials."""
    left, kept, out = np.maximum(n, 0).astype(np.int64), np.ones(np.shape(n)), []
    for p in exit_probabilities([np.broadcast_to(r, np.shape(n)) for r in rates], dt):
        chance = np.clip(np.divide(p, kept, out=np.zeros_like(kept), where=kept > 0), 0, 1)
        gone = rng.binomial(left, chance)
        out.append(gone.astype(float))
        left, kept = left - gone, kept - p
    return out


def exits_logpmf(n: np.ndarray, gone: list[np.ndarray], rates: list[np.ndarray], dt: float) -> np.ndarray:
    """Log probability of an Euler-multinomial outcome."""
    ps = exit_probabilities([np.broadcast_to(r, np.shape(n)) for r in rates], dt)
    stay, rest = n - sum(gone), 1 - sum(ps)
    out = lgamma(n + 1) - lgamma(stay + 1) + np.where(stay > 0, stay * np.log(np.maximum(rest, 1e-300)), 0)
    for g, p in zip(gone, ps):
        out = out - lgamma(g + 1) + np.where(g > 0, g * np.log(np.maximum(p, 1e-300)), 0)
    return out


def nbinom_logpmf(y, mu, size) -> np.ndarray:
    return lgamma(y + size) - lgamma(size) - lgamma(y + 1) + size * np.log(size / (size + mu)) + y * np.log(mu / (size + mu))


def linear_gaussian(dx: int = 1, dy: int = 1) -> Model:
    """x' = A x + L_Q z, y = C x + L_R e; parameters are entries of A, C, the lower Cholesky factors, and the start."""
    a = [(i, j) for i in range(dx) for j in range(dx)]
    c = [(i, j) for i in range(dy) for j in range(dx)]
    q = [(i, j) for i in range(dx) for j in range(i + 1)]
    r = [(i, j) for i in range(dy) for j in range(i + 1)]
    label = lambda n, ij: f"{n}{ij[0] + 1}{ij[1] + 1}"
    names = tuple(label("A", x) for x in a) + tuple(label("C", x) for x in c) + tuple(label("Q", x) for x in q) + tuple(label("R", x) for x in r) + tuple(f"X0_{i + 1}" for i in range(dx))

    def combine(n: str, entries, theta, z: list, size: int) -> list:
        out = [0.0] * size
        for ij in entries:
            out[ij[0]] = out[ij[0]] + theta[label(n, ij)] * z[ij[1]]
        return out

    def shock(n: str, entries, theta, size: int, count: int, rng) -> list:
        return combine(n, entries, theta, [rng.standard_normal(count) for _ in range(size)], size)

    def rinit(theta, covars, t, n, rng):
        e = shock("Q", q, theta, dx, n, rng)
        return {f"X{i + 1}": theta[f"X0_{i + 1}"] + e[i] for i in range(dx)}

    def rproc(x, theta, covars, t, dt, rng):
        old = [x[f"X{i + 1}"] for i in range(dx)]
        mean, e = combine("A", a, theta, old, dx), shock("Q", q, theta, dx, len(old[0]), rng)
        return {f"X{i + 1}": mean[i] + e[i] for i in range(dx)}

    def means(x, theta):
        return combine("C", c, theta, [x[f"X{i + 1}"] for i in range(dx)], dy)

    def dmeas(y, x, theta, covars, t):
        gap = [y[f"Y{i + 1}"] - m for i, m in enumerate(means(x, theta))]
        total, solved = 0.0, []
        for i in range(dy):  # forward substitution with the Cholesky factor
            v = gap[i]
            for j in range(i):
                v = v - theta[f"R{i + 1}{j + 1}"] * solved[j]
            d = theta[f"R{i + 1}{i + 1}"]
            solved.append(v / d)
            total = total - 0.5 * np.log(2 * np.pi) - np.log(d) - 0.5 * solved[i] * solved[i]
        return total

    def rmeas(x, theta, covars, t, rng):
        m = means(x, theta)
        e = shock("R", r, theta, dy, len(x["X1"]), rng)
        return {f"Y{i + 1}": m[i] + e[i] for i in range(dy)}

    logs = tuple(label(n, ij) for n, entries in (("Q", q), ("R", r)) for ij in entries if ij[0] == ij[1])
    return Model("linear_gaussian", tuple(f"X{i + 1}" for i in range(dx)), tuple(f"Y{i + 1}" for i in range(dy)), names, rinit, rproc, dmeas, rmeas, transform=Transform(log=logs))


def sir() -> Model:
    """Seasonal SIR with gamma noise on transmission and negative-binomial reports of recoveries."""
    names = ("gamma", "mu", "iota", "beta1", "beta2", "beta3", "beta_sd", "pop", "rho", "k", "S_0", "I_0", "R_0")

    def rinit(theta, covars, t, n, rng):
        scale = theta["pop"] / (theta["S_0"] + theta["I_0"] + theta["R_0"])
        out = {s: np.broadcast_to(np.round(scale * theta[f"{s}_0"]), n).astype(float).copy() for s in "SIR"}
        return out | {"cases": np.zeros(n), "W": np.zeros(n), "logw": np.zeros(n)}

    def rproc(x, theta, covars, t, dt, rng):
        n = len(x["S"])
        beta = sum(theta[f"beta{k}"] * covars[f"seas_{k}"] for k in (1, 2, 3))
        var = np.broadcast_to(theta["beta_sd"] ** 2, n) + 1e-10
        dw = rng.standard_gamma(dt / var) * var
        force = (theta["iota"] + beta * x["I"] * dw / dt) / theta["pop"]
        births = rng.poisson(np.broadcast_to(theta["mu"] * theta["pop"] * dt, n))
        s_i, s_d = draw_exits(x["S"], [force, theta["mu"]], dt, rng)
        i_r, i_d = draw_exits(x["I"], [theta["gamma"], theta["mu"]], dt, rng)
        (r_d,) = draw_exits(x["R"], [theta["mu"]], dt, rng)
        logw = exits_logpmf(x["S"], [s_i, s_d], [force, theta["mu"]], dt) + exits_logpmf(x["I"], [i_r, i_d], [theta["gamma"], theta["mu"]], dt) + exits_logpmf(x["R"], [r_d], [theta["mu"]], dt)
        return {
            "S": x["S"] + births - s_i - s_d, "I": x["I"] + s_i - i_r - i_d, "R": x["R"] + i_r - r_d,
            "cases": x["cases"] + i_r, "W": x["W"] + (dw - dt) / np.sqrt(var), "logw": x["logw"] + np.where(np.isfinite(logw), logw, 0.0),
        }

    def dmeas(y, x, theta, covars, t):
        return nbinom_logpmf(y["reports"], np.maximum(theta["rho"] * x["cases"], 1e-10), 1 / theta["k"]) + 0 * x["cases"]

    def rmeas(x, theta, covars, t, rng):
        mu, size = np.maximum(theta["rho"] * x["cases"], 1e-10), 1 / theta["k"]
        return {"reports": rng.poisson(rng.standard_gamma(np.broadcast_to(size, mu.shape)) * mu / size).astype(float)}

    logs = ("gamma", "mu", "iota", "beta1", "beta2", "beta3", "beta_sd", "pop", "k")
    return Model("sir", ("S", "I", "R", "cases", "W", "logw"), ("reports",), names, rinit, rproc, dmeas, rmeas, accumulators=("cases", "logw"), covariates=("seas_1", "seas_2", "seas_3"), transform=Transform(log=logs, logit=("rho",), simplex=(("S_0", "I_0", "R_0"),)), logw="logw")


def stochastic_volatility() -> Model:
    """Returns with a mean-reverting variance whose shocks share the returns' own."""
    names = ("mu", "kappa", "theta", "xi", "rho", "V_0")

    def rinit(theta, covars, t, n, rng):
        return {"V": np.broadcast_to(np.asarray(theta["V_0"], float), n).copy(), "S": np.full(n, 1.0)}

    def rproc(x, theta, covars, t, dt, rng):
        v = x["V"]
        shock = (covars["y_prev"] - theta["mu"] + 0.5 * v) / np.sqrt(v)
        w = theta["rho"] * shock + np.sqrt(1 - theta["rho"] ** 2) * rng.standard_normal(len(v))
        new = np.maximum(v + theta["kappa"] * (theta["theta"] - v) + theta["xi"] * np.sqrt(v) * w, 1e-32)
        return {"V": new, "S": x["S"] * np.exp(theta["mu"] - 0.5 * new)}

    def dmeas(y, x, theta, covars, t):
        v = x["V"]
        return -0.5 * (np.log(2 * np.pi * v) + (y["y"] - theta["mu"] + 0.5 * v) ** 2 / v)

    def rmeas(x, theta, covars, t, rng):
        return {"y": theta["mu"] - 0.5 * x["V"] + np.sqrt(x["V"]) * rng.standard_normal(len(x["V"]))}

    return Model("stochastic_volatility", ("V", "S"), ("y",), names, rinit, rproc, dmeas, rmeas, covariates=("y_prev",), transform=Transform(log=("kappa", "theta", "xi", "V_0")))


#: Measles variants: who has death and mixing parameters, and whose imports follow the population.
MEASLES = ("001", "001b", "001d", "002", "002d", "003")
_DEATHS = 0.02


def softened(x, floor: float = 0.0, sharpness: float = 100.0):
    """A smooth maximum of x and floor."""
    z = sharpness * (x - floor)
    return floor + (np.maximum(z, 0.0) + np.log1p(np.exp(-np.absolute(z)))) / sharpness


def measles(variant: str = "001") -> Model:
    """SEIR with cohort entry, school terms and gamma noise on transmission; cases are a rounded normal of the removals.

    001 has a death rate mu and a mixing exponent alpha; 001b fixes mu at 0.02 and mixes
    evenly; 002 is 001b with imports exp(iota1 + iota2 * std_log_pop_1950), a covariate that
    is standardised over the units; the d variants are 001b and 002 that also accumulate the
    log density of their draws. 003 is 001b with normal flows, softened at zero, whose cases
    follow the infections.
    """
    if variant not in MEASLES:
        raise ValueError(f"no measles model {variant!r}")
    weighed, smooth, imports = variant.endswith("d"), variant == "003", variant.startswith("002")
    names = ("R0", "sigma", "gamma", *(("iota1", "iota2") if imports else ("iota",)), "rho", "sigmaSE", "psi", "cohort", "amplitude", *(("mu", "alpha") if variant == "001" else ()), "S_0", "E_0", "I_0", "R_0")

    def rinit(theta, covars, t, n, rng):
        m = covars["pop"] / (theta["S_0"] + theta["E_0"] + theta["I_0"] + theta["R_0"])
        at = lambda v: v if smooth else np.round(v)
        out = {s: at(m * theta[f"{s}_0"]) + np.zeros(n) for s in "SEIR"}
        return out | {"W": np.zeros(n), "C": np.zeros(n)} | ({"logw": np.zeros(n)} if weighed else {})

    def drift(x, theta, covars, t, dt):
        """(births a year, expected force of infection, death rate) of a step."""
        year = t - np.floor(t)
        entry = abs(year - 251.0 / 365.0) < 0.5 * dt
        births = theta["cohort"] * covars["birthrate"] / dt * entry + (1 - theta["cohort"]) * covars["birthrate"]
        mu = theta["mu"] if variant == "001" else _DEATHS
        beta = theta["R0"] * school_season(t, theta["amplitude"]) * (1 - np.exp(-(theta["gamma"] + mu) * dt)) / dt
        brought = np.exp(theta["iota1"] + theta["iota2"] * covars["std_log_pop_1950"]) if imports else theta["iota"]
        mixing = theta["alpha"] if variant == "001" else 1.0
        return births, beta * (x["I"] + brought) ** mixing / covars["pop"], mu

    def rproc(x, theta, covars, t, dt, rng):
        n = len(x["S"])
        births, force, mu = drift(x, theta, covars, t, dt)
        var = theta["sigmaSE"] ** 2 + np.zeros(n)
        dw = rng.standard_gamma(value(dt / var)) * var
        rate = force * dw / dt
        noise = {"W": x["W"] + (dw - dt) / theta["sigmaSE"]}
        if smooth:
            z = [rng.standard_normal(n) for _ in range(7)]
            born = softened(births * dt + np.sqrt(softened(births * dt + np.zeros(n))) * z[0])
            means = [rate * x["S"] * dt, mu * x["S"] * dt, theta["sigma"] * x["E"] * dt, mu * x["E"] * dt, theta["gamma"] * x["I"] * dt, mu * x["I"] * dt]
            s_e, s_d, e_i, e_d, i_r, i_d = (m + np.sqrt(softened(m)) * e for m, e in zip(means, z[1:]))
            out = {"S": softened(x["S"] + born - s_e - s_d), "E": softened(x["E"] + s_e - e_i - e_d), "I": softened(x["I"] + e_i - i_r - i_d)}
            return out | {"R": softened(covars["pop"] - out["S"] - out["E"] - out["I"]), "C": softened(x["C"] + e_i)} | noise
        expected = np.broadcast_to(np.maximum(value(births) * dt, 0), n)
        born = rng.poisson(expected)
        flows = {"S": [rate, mu], "E": [theta["sigma"], mu], "I": [theta["gamma"], mu]}
        gone = {k: draw_exits(x[k], [value(r) for r in rates], dt, rng) for k, rates in flows.items()}
        out = {"S": x["S"] + born - sum(gone["S"]), "E": x["E"] + gone["S"][0] - sum(gone["E"]), "I": x["I"] + gone["E"][0] - sum(gone["I"])}
        out |= {"R": covars["pop"] - out["S"] - out["E"] - out["I"], "C": x["C"] + gone["I"][0]} | noise
        if weighed:
            w = np.where(expected > 0, born * np.log(np.maximum(expected, 1e-300)) - expected - lgamma(born + 1.0), 0.0)
            for k, rates in flows.items():
                w = w + exits_logpmf(x[k], gone[k], rates, dt)
            out["logw"] = x["logw"] + np.where(np.isfinite(value(w)), w, 0.0)
        return out

    def moments(x, theta):
        mean = theta["rho"] * (np.maximum(x["C"], 0.0) if weighed or smooth else x["C"])
        return mean, mean * (1 - theta["rho"] + theta["psi"] ** 2 * mean)

    def dmeas(y, x, theta, covars, t):
        if np.isnan(y["cases"]):
            return np.zeros(len(x["C"]))
        mean, var = moments(x, theta)
        sd = np.sqrt(np.maximum(var, 1e-24)) if weighed or smooth else np.sqrt(np.maximum(var, 0.0)) + 1e-18
        low = (y["cases"] - 0.5 - mean) / sd if y["cases"] > 1e-12 else np.full(len(x["C"]), -np.inf)
        density = log_diff_ndtr(low, (y["cases"] + 0.5 - mean) / sd)
        if weighed or smooth:
            return np.maximum(density, np.log(1e-12))
        return np.where(value(x["C"]) < 0, -np.inf, np.logaddexp(density, np.log(1e-18)))

    def rmeas(x, theta, covars, t, rng):
        if smooth:
            mean = theta["rho"] * softened(x["C"])
            var = mean * (1 - theta["rho"] + theta["psi"] ** 2 * mean)
            return {"cases": softened(rng.standard_normal(len(mean)) * (np.sqrt(softened(var)) + 1e-18) + mean)}
        mean, var = moments(x, theta)
        drawn = rng.standard_normal(len(mean)) * (np.sqrt(np.maximum(var, 0.0)) + 1e-18) + mean
        return {"cases": np.where(drawn > 0, np.round(drawn), 0.0)}

    logs = ("R0", "sigma", "gamma", *(() if imports else ("iota",)), "sigmaSE", "psi", *(("mu", "alpha") if variant == "001" else ()))
    extra = ("logw",) if weighed else ()
    return Model(f"measles_{variant}", ("S", "E", "I", "R", "W", "C", *extra), ("cases",), names, rinit, rproc, dmeas, rmeas, accumulators=("W", "C", *extra), covariates=("pop", "birthrate", *(("std_log_pop_1950",) if imports else ())), transform=Transform(log=logs, logit=("rho", "cohort", "amplitude"), simplex=(("S_0", "E_0", "I_0", "R_0"),)), logw="logw" if weighed else None)


def school_season(t: float, amplitude):
    """The factor of transmission: up in school terms, down in holidays, one on average."""
    day = (t - np.floor(t)) * 365.25
    term = 7 <= day <= 100 or 115 <= day <= 199 or 252 <= day <= 300 or 308 <= day <= 356
    return 1 + amplitude * 0.2411 / 0.7589 if term else 1 - amplitude


def cholera(noise: str = "normal") -> Model:
    """Susceptibles, infected, inapparent cases and three recovered classes with seasonal spread and an environmental reservoir; deaths are observed.

    The force of infection has the exponent alpha; its noise is normal and added, or gamma
    and multiplied. A state that falls below zero is counted, set to zero, and floors the
    density of its line from then on.
    """
    if noise not in ("normal", "gamma"):
        raise ValueError(f"no cholera noise {noise!r}")
    parts = ("S", "I", "Y", "R1", "R2", "R3")
    names = ("gamma", "m", "rho", "epsilon", "c", "beta_trend", "sigma", "tau", "alpha", "delta", *[f"{p}_0" for p in parts], *[f"bs{i}" for i in range(1, 7)], *[f"omegas{i}" for i in range(1, 7)])

    def rinit(theta, covars, t, n, rng):
        total = sum(theta[f"{p}_0"] for p in parts)
        return {p: covars["pop"] * theta[f"{p}_0"] / total + np.zeros(n) for p in parts} | {"Mn": np.zeros(n), "count": np.zeros(n)}

    def rproc(x, theta, covars, t, dt, rng):
        n, pop, delta = len(x["S"]), covars["pop"], theta["delta"]
        seasonal = lambda name: sum(theta[f"{name}{i}"] * covars[f"seas{i}"] for i in range(1, 7))
        beta, omega = np.exp(theta["beta_trend"] * covars["trend"] + seasonal("bs")), np.exp(seasonal("omegas"))
        spread = (x["I"] / pop) ** theta["alpha"]
        if noise == "normal":
            spread = (beta + theta["sigma"] * rng.standard_normal(n) * np.sqrt(dt) / dt) * spread
        else:
            var = theta["sigma"] ** 2 + np.zeros(n)
            spread = beta * rng.standard_gamma(value(dt / var)) * var / dt * spread
        infections = (omega + spread) * x["S"]
        recovered, dying, returned = theta["gamma"] * x["I"], theta["m"] * x["I"], theta["rho"] * x["Y"]
        waning = [3 * theta["epsilon"] * x[r] for r in ("R1", "R2", "R3")]
        change = {
            "S": covars["dpopdt"] + delta * pop - infections - delta * x["S"] + waning[2] + returned,
            "I": theta["c"] * infections - dying - delta * x["I"] - recovered,
            "Y": (1 - theta["c"]) * infections - delta * x["Y"] - returned,
            "R1": recovered - waning[0] - delta * x["R1"], "R2": waning[0] - waning[1] - delta * x["R2"], "R3": waning[1] - waning[2] - delta * x["R3"],
            "Mn": dying,
        }
        moved = {k: x[k] + v * dt for k, v in change.items()}
        below = np.zeros(n, bool)
        for v in moved.values():
            below = below | (value(v) < 0)
        return {k: np.maximum(v, 0.0) for k, v in moved.items()} | {"count": x["count"] + below}

    def dmeas(y, x, theta, covars, t):
        v = theta["tau"] * x["Mn"]
        sd = v + 1e-18
        density = -0.5 * np.log(2 * np.pi) - np.log(sd) - 0.5 * ((y["deaths"] - x["Mn"]) / sd) ** 2
        top = np.maximum(density, np.log(1e-18))
        floored = top + np.log(np.exp(density - top) + np.exp(np.log(1e-18) - top))
        return np.where((value(x["count"]) > 0) | ~np.isfinite(value(v)), np.log(1e-18), floored)

    def rmeas(x, theta, covars, t, rng):
        return {"deaths": x["Mn"] + theta["tau"] * x["Mn"] * rng.standard_normal(len(x["Mn"]))}

    logs = ("gamma", "m", "rho", "epsilon", "sigma", "tau", "alpha", "delta")
    transform = Transform(log=logs, logit=("c",), simplex=(tuple(f"{p}_0" for p in parts),), scaled=(("beta_trend", 100.0),))
    return Model("cholera", (*parts, "Mn", "count"), ("deaths",), names, rinit, rproc, dmeas, rmeas, accumulators=("Mn",), covariates=("trend", "dpopdt", "pop", *[f"seas{i}" for i in range(1, 7)]), transform=transform)
