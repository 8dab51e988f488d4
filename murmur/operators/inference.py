"""Particle algorithms as DataFrame operators.

Each series is packed into one row of arrays; jobs (series x parameter set x replicate or
chain) are rows, dealt out by their keys to a fixed number of partitions, and a task runs
one job after the other in ``mapInPandas``. Random streams belong to a job's keys, so
results depend on neither partitioning nor retries. Only parameter sets are small enough
to be broadcast; series are joined.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.optimizers import OPTIMIZERS
from murmur.functions.rng import Expected, generator, stream
from murmur.operators import grid as grids
from murmur.operators import kernels
from murmur.operators.kernels import Perturbation, Series
from murmur.operators.models import Model


def packed(series: DataFrame, model: Model, t0: float | DataFrame, *, covars: DataFrame | None = None, dt: float | None = None, nstep: int | None = None, order: str = "linear", rename: dict[str, str] | None = None) -> DataFrame:
    """(series_id, t0, obs, grid): a series' observations, interval steps and covariates as arrays in time order."""
    ys = series.withColumnsRenamed(rename or {})
    if missing := set(model.observed) - set(ys.columns):
        raise KeyError(f"observed columns missing: {sorted(missing)}")
    if model.covariates and covars is None:
        raise ValueError(f"{model.name} needs covariates {model.covariates}")
    ys = ys.select("series_id", F.col("time").cast("double").alias("time"), *[F.col(c).cast("double").alias(c) for c in model.observed])
    intervals = grids.interval_steps(ys, t0, dt=dt, nstep=nstep).select("series_id", F.col("t_to").alias("time"), "t_from", "nstep", "dt")
    one = F.struct("time", "nstep", "dt", "t_from", *model.observed)
    obs = ys.join(intervals, ["series_id", "time"]).groupBy("series_id").agg(F.array_sort(F.collect_list(one)).alias("obs"))
    if not model.covariates:
        return obs.withColumn("grid", F.array().cast("array<struct<t:double>>"))
    points = grids.steps(grids.interval_steps(ys, t0, dt=dt, nstep=nstep))
    at = grids.interpolate(points, covars, list(model.covariates), order=order)
    grid = at.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", *model.covariates))).alias("grid"))
    return obs.join(grid, "series_id")


def _series(row, model: Model) -> Series:
    obs, grid = list(row.obs), list(row.grid)
    column = lambda rows, c: np.array([np.nan if r[c] is None else r[c] for r in rows], float)
    return Series(float(obs[0]["t_from"]), column(obs, "time"), column(obs, "nstep").astype(int), column(obs, "dt"), {c: column(obs, c) for c in model.observed}, {c: column(grid, c) for c in model.covariates})


#: Packed series of up to so many times and sub-steps in all are broadcast to their jobs (some 30 MB).
BROADCAST_POINTS = 500_000


def _jobs(data: DataFrame, theta: DataFrame, reps: int) -> DataFrame:
    """A row a job with its series: light keys are dealt out evenly, and small series are broadcast to them.

    Many or long series meet the parameter sets where they are and are dealt out by job.
    """
    spark, sets = data.sparkSession, theta.select("theta_idx", "params")
    size = data.agg(F.sum(F.size("obs") + F.size("grid")).alias("points"), F.count("*").alias("series")).first()
    n_sets = sets.count()
    sets = F.broadcast(sets) if n_sets <= 100_000 else sets
    keys = data.select("series_id") if (size.points or 0) <= BROADCAST_POINTS else data
    keys = (F.broadcast(keys) if n_sets > 100_000 and keys is not data else keys).join(sets).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    most = 4 * spark.sparkContext.defaultParallelism
    if (size.points or 0) > BROADCAST_POINTS:
        return keys.repartition(most, "series_id", "theta_idx", "rep")
    return keys.repartition(max(min(most, size.series * n_sets * reps), 1)).join(F.broadcast(data), "series_id")


def _run(jobs: DataFrame, model: Model, schema: str, job: Callable, seed: int, draws: str = "philox") -> DataFrame:
    """``job(model, theta, series, rng)`` -> rows, for each job row."""
    blob = jobs.sparkSession.sparkContext.broadcast(_dumped((model, job)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kernel = pickle.loads(blob.value)
        for frame in frames:
            for row in frame.itertuples(index=False):
                keys = (row.series_id, row.theta_idx, row.rep)
                rows = pd.DataFrame(kernel(own, _ordered(row.params, own), _series(row, own), stream(draws, seed, *keys)))
                for name, key in zip(("rep", "theta_idx", "series_id"), keys[::-1]):
                    rows.insert(0, name, key)
                yield rows

    return jobs.mapInPandas(run, "series_id string, theta_idx int, rep int, " + schema)


def _ordered(params, model: Model) -> dict[str, float]:
    """Parameters in the model's order, on which the order of draws depends; a map has none."""
    found = dict(params)
    return {n: found[n] for n in model.parameters if n in found} | found


def _dumped(x) -> bytes:
    from pyspark import cloudpickle

    return cloudpickle.dumps(x)


def pfilter(data: DataFrame, model: Model, theta: DataFrame, *, particles: int, reps: int = 1, thresh: float = 0.0, seed: int = 1, draws: str = "philox") -> DataFrame:
    """(series_id, theta_idx, rep, time, cll, ess, filter_mean, prediction_mean); means are maps of the states."""
    def job(m, th, s, rng):
        out = kernels.pfilter(m, th, s, particles, rng, thresh=max(thresh, 0.0))
        return {"time": s.times} | {k: out[k] for k in ("cll", "ess", "filter_mean", "prediction_mean")}

    means = "filter_mean map<string,double>, prediction_mean map<string,double>"
    return _run(_jobs(data, theta, reps), model, f"time double, cll double, ess double, {means}", job, seed, draws)


def logliks(steps: DataFrame) -> DataFrame:
    """(series_id, theta_idx, rep, loglik) of a filter's steps."""
    return steps.groupBy("series_id", "theta_idx", "rep").agg(F.sum("cll").alias("loglik"))


def simulate(data: DataFrame, model: Model, theta: DataFrame, *, sims: int, seed: int = 1, chunk: int = 100, draws: str = "philox") -> tuple[DataFrame, DataFrame]:
    """States (start and every time) and observations: (series_id, theta_idx, sim, time, columns...).

    A job simulates ``chunk`` paths (or ``sims``, if these are fewer) at once, states and observations together; a chunk is a
    stream of its own. Both tables are cut from the same job's rows, whose states alone have
    a row at the start.
    """
    def job(m, th, s, rng):
        states, observed = kernels.simulate(m, th, s, chunk, rng)
        n, times = len(states), np.concatenate([[s.t0], s.times])
        seen = {o: np.vstack([np.full((1, chunk), np.nan)] + [row[o][None, :] for row in observed]) for o in m.observed}
        held = {x: np.vstack([np.broadcast_to(row[x], (1, chunk)) for row in states]) for x in m.states}
        rows = {"path": np.tile(np.arange(chunk), n), "step": np.repeat(np.arange(n), chunk), "time": np.repeat(times, chunk)}
        return rows | {f"x_{k}": v.ravel() for k, v in held.items()} | {f"y_{k}": v.ravel() for k, v in seen.items()}

    chunk = min(chunk, sims)
    columns = [f"x_{n}" for n in model.states] + [f"y_{n}" for n in model.observed]
    schema = "path int, step int, time double, " + ", ".join(f"`{c}` double" for c in columns)
    paths = _run(_jobs(data, theta, -(-sims // chunk)), model, schema, job, seed, draws).withColumn("sim", F.col("rep") * chunk + F.col("path")).where(F.col("sim") < sims)
    cut = lambda rows, kind, names: rows.select("series_id", "theta_idx", "sim", "time", *[F.col(f"{kind}_{n}").alias(n) for n in names])
    return cut(paths, "x", model.states), cut(paths.where("step > 0"), "y", model.observed)


def skeleton(states: DataFrame, model: Model, theta: dict[str, float], *, time: float, dt: float, keys: list[str]) -> DataFrame:
    """One step of the model's deterministic skeleton, from the states and covariates of every row: ``keys`` and the states after it.

    Draws are replaced by their expectations. A narrow step over batches of rows.
    """
    blob = states.sparkSession.sparkContext.broadcast(_dumped((model, theta)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at = pickle.loads(blob.value)
        for frame in frames:
            arrays = {c: frame[c].to_numpy(float) for c in (*own.states, *own.covariates)}
            after = own.rproc({k: arrays[k] for k in own.states}, at, {k: arrays[k] for k in own.covariates}, time, dt, Expected())
            yield pd.DataFrame({k: frame[k] for k in keys} | {k: np.asarray(after[k], float) for k in own.states})

    rows = states.select(*keys, *[F.col(c).cast("double").alias(c) for c in (*model.states, *model.covariates)])
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(run, kinds + ", " + ", ".join(f"`{k}` double" for k in model.states))


def as_series(observed: DataFrame) -> DataFrame:
    """The first simulation of the first set as data."""
    return observed.where("theta_idx = 0 AND sim = 0").drop("theta_idx", "sim")


def _traced(columns: str, model: Model) -> str:
    return columns + ", " + ", ".join(f"`{n}` double" for n in model.parameters)


def mif(data: DataFrame, model: Model, theta: DataFrame, *, particles: int, iterations: int, perturbation: Perturbation, thresh: float = 0.0, monitors: int = 0, seed: int = 1, draws: str = "philox") -> DataFrame:
    """Iterated filtering: (series_id, theta_idx, rep, iteration, loglik, parameters...)."""
    job = lambda m, th, s, rng: kernels.mif(m, th, s, particles, iterations, perturbation, rng, thresh=thresh, monitors=monitors)
    return _run(_jobs(data, theta, 1), model, _traced("iteration int, loglik double", model), job, seed, draws)


def pmcmc(data: DataFrame, model: Model, theta: DataFrame, *, particles: int, iterations: int, proposal: Callable, thresh: float = 0.0, chains: int = 1, seed: int = 1) -> DataFrame:
    """Chains of particle MCMC; ``proposal()`` makes a chain's own proposal."""
    job = lambda m, th, s, rng: kernels.pmcmc(m, th, s, particles, iterations, proposal(), rng, thresh=thresh)
    return _run(_jobs(data, theta, chains), model, _traced("iteration int, loglik double, log_prior double, accepted boolean", model), job, seed)


def abc(data: DataFrame, model: Model, theta: DataFrame, *, iterations: int, proposal: Callable, probes: dict[str, Callable], scale: dict[str, float], epsilon: float, chains: int = 1, seed: int = 1) -> DataFrame:
    job = lambda m, th, s, rng: kernels.abc(m, th, s, iterations, proposal(), probes, scale, epsilon, rng)
    return _run(_jobs(data, theta, chains), model, _traced("iteration int, distance double, log_prior double, accepted boolean", model), job, seed)


def mop(data: DataFrame, model: Model, theta: DataFrame, *, particles: int, alpha: float = 0.97, dpop: bool = False, reps: int = 1, seed: int = 1, draws: str = "philox") -> DataFrame:
    """(series_id, theta_idx, rep, loglik) by off-parameter weights; with dpop the process's own density counts too."""
    def job(m, th, s, rng):
        est = {k: float(v) for k, v in m.transform.to_est(th).items()}
        return [{"loglik": -len(s.times) * float(kernels.mop(m, est, s, particles, alpha, rng, dpop=dpop))}]

    return _run(_jobs(data, theta, reps), model, "loglik double", job, seed, draws)


def panel_mop(data: DataFrame, model: Model, theta: DataFrame, *, reps: int = 1, **settings) -> DataFrame:
    """(theta_idx, rep, loglik): the sum over units, whose filters are jobs of their own; theta holds every unit's parameters."""
    return mop(data, model, theta, reps=reps, **settings).groupBy("theta_idx", "rep").agg(F.sum("loglik").alias("loglik"))


def train(data: DataFrame, model: Model, theta: DataFrame, *, particles: int, iterations: int, rates: np.ndarray, names: list[str], optimizer: str = "Adam", alpha: float = 0.97, dpop: bool = False, monitors: int = 0, seed: int = 1) -> DataFrame:
    """Gradient training: (series_id, theta_idx, rep, iteration, loglik, parameters...)."""
    def job(m, th, s, rng):
        rows = kernels.train(m, th, {"s": s}, particles, iterations, rates, names, rng, optimizer=optimizer, alpha=alpha, dpop=dpop, monitors=monitors)
        return [{k: v for k, v in r.items() if k != "unit"} for r in rows]

    return _run(_jobs(data, theta, 1), model, _traced("iteration int, loglik double", model), job, seed)


def _by_unit(a, b):
    return F.when(a["series_id"] < b["series_id"], -1).when(a["series_id"] > b["series_id"], 1).otherwise(0)


def _panel(data: DataFrame, theta_shared: DataFrame, theta_unit: DataFrame, model: Model, schema: str, job: Callable, seed: int) -> DataFrame:
    """One job a parameter set, which holds all units: they are coupled through the shared parameters."""
    shared = theta_shared.groupBy("theta_idx").agg(F.map_from_entries(F.collect_list(F.struct("parameter", "value"))).alias("shared"))
    unit = theta_unit.groupBy("theta_idx", F.col("unit").alias("series_id")).agg(F.map_from_entries(F.collect_list(F.struct("parameter", "value"))).alias("own"))
    jobs = unit.join(data, "series_id").groupBy("theta_idx").agg(F.array_sort(F.collect_list(F.struct("series_id", "own", "obs", "grid")), _by_unit).alias("units")).join(shared, "theta_idx")
    jobs = jobs.repartition(2 * jobs.sparkSession.sparkContext.defaultParallelism, "theta_idx")
    blob = jobs.sparkSession.sparkContext.broadcast(_dumped((model, job)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kernel = pickle.loads(blob.value)
        for frame in frames:
            for row in frame.itertuples(index=False):
                units = {u["series_id"]: _series(pd.Series(u), own) for u in row.units}
                specific = {u["series_id"]: _ordered(u["own"], own) for u in row.units}
                rows = pd.DataFrame(kernel(own, _ordered(row.shared, own), specific, units, generator(seed, row.theta_idx)))
                rows.insert(0, "theta_idx", row.theta_idx)
                yield rows.reindex(columns=["theta_idx", "iteration", "unit", "loglik", *own.parameters])

    return jobs.mapInPandas(run, "theta_idx int, " + schema)


def panel_mif(data: DataFrame, model: Model, theta_shared: DataFrame, theta_unit: DataFrame, *, particles: int, iterations: int, perturbation: Perturbation, block: bool = True, seed: int = 1) -> DataFrame:
    """Panel iterated filtering: (theta_idx, iteration, unit or shared, loglik, parameters...)."""
    job = lambda m, shared, own, units, rng: kernels.panel_mif(m, shared, own, units, particles, iterations, perturbation, rng, block=block)
    return _panel(data, theta_shared, theta_unit, model, _traced("iteration int, unit string, loglik double", model), job, seed)


def panel_train(data: DataFrame, model: Model, theta_shared: DataFrame, theta_unit: DataFrame, *, particles: int, iterations: int, rates: np.ndarray, names: list[str], optimizer: str = "Adam", alpha: float = 0.97, dpop: bool = False, monitors: int = 0, seed: int = 1) -> DataFrame:
    """Panel training, with dpop by the process's own density too: (theta_idx, iteration, unit, loglik of the panel, parameters...)."""
    def job(m, shared, own, units, rng):
        specific = tuple(next(iter(own.values())))
        return kernels.train(m, shared | next(iter(own.values())), units, particles, iterations, rates, names, rng, optimizer=optimizer, alpha=alpha, dpop=dpop, specific=specific, units=own, monitors=monitors)

    return _panel(data, theta_shared, theta_unit, model, _traced("iteration int, unit string, loglik double", model), job, seed)


def descent(starts: DataFrame, optimizer: str, gradient: Callable, hessian: Callable, objective: Callable, *, steps: int, rate: float, keys: list[str], **settings) -> DataFrame:
    """(keys..., step, x): the path of an optimizer on a function of one variable from every row's ``x``; the functions get (x, row)."""
    blob = starts.sparkSession.sparkContext.broadcast(_dumped((optimizer, gradient, hessian, objective, settings)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, g, h, f, options = pickle.loads(blob.value)
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                own, x = OPTIMIZERS[name](**options), np.array([row["x"]])
                for i in range(steps):
                    x = own.step(x, np.array([g(x[0], row)]), np.array([[h(x[0], row)]]), i, np.array([rate]), lambda z, row=row: f(z[0], row), f(x[0], row))
                    rows.append({k: row[k] for k in keys} | {"step": i + 1, "x": float(x[0])})
            yield pd.DataFrame(rows, columns=[*keys, "step", "x"])

    kinds = ", ".join(f"{k} {starts.schema[k].dataType.simpleString()}" for k in keys)
    return starts.mapInPandas(run, f"{kinds}, step int, x double")


def check_panel(data: DataFrame) -> DataFrame:
    """Units whose number of times or start differs from the panel's first: empty for a sound panel."""
    shape = F.struct(F.size("obs").alias("n"), F.element_at("obs", 1)["t_from"].alias("t0"))
    first = data.agg(F.min_by(shape, "series_id").alias("s")).scalar()
    return data.where(shape != first).select("series_id", shape.alias("shape"))
