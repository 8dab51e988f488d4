"""Queries of the particle algorithms: no SQL form; tests hold them against exact filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import splines
from murmur.functions.optimizers import learning_rates
from murmur.functions.proposals import AdaptiveWalk, DiagonalWalk
from murmur.operators import grid, inference, models, profiles, results, theta
from murmur.operators.kernels import Perturbation
from murmur.sources import series

QUERIES: dict = {}
START = {"A11": 0.8, "C11": 1.0, "Q11": 0.3, "R11": 0.25, "X0_1": 0.0}
WALK = Perturbation({"A11": 0.02, "Q11": 0.02, "R11": 0.02}, cooling=lambda frac: 0.5 ** (frac / 20))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """S1, its days counted from 1."""
    daily = series.daily_orders(spark, sf)
    start = daily.agg(F.min("time").alias("t")).scalar()
    return daily.withColumn("time", F.col("time") - start + 1)


def _daily(spark: SparkSession, sf: str) -> tuple[DataFrame, models.Model]:
    """S1 with the linear Gaussian model."""
    model = models.linear_gaussian()
    model.tried(START)
    return inference.packed(_days(spark, sf), model, 0.0, nstep=1, rename={"y": "Y1"}), model


def _panel(spark: SparkSession, sf: str) -> tuple[DataFrame, models.Model]:
    model = models.linear_gaussian()
    by_unit = series.monthly_by_nation(spark, sf)
    mean = by_unit.groupBy("series_id").agg(F.avg("y").alias("m"), F.min("time").alias("t"))
    centred = by_unit.join(F.broadcast(mean), "series_id").select("series_id", (F.col("time") - F.col("t") + 1).alias("time"), (F.col("y") - F.col("m")).alias("y"))
    return inference.packed(centred, model, 0.0, nstep=1, rename={"y": "Y1"}), model


def _starts(spark: SparkSession, n: int = 4) -> DataFrame:
    box = {"A11": (0.4, 0.9), "C11": (1.0, 1.0), "Q11": (0.2, 0.8), "R11": (0.2, 0.8), "X0_1": (0.0, 0.0)}
    return theta.sample(spark, box, n, 11)


def _panel_starts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    units = [r["n_name"] for r in series.read_table(spark, sf, "nation").select("n_name").collect()]  # 25 nations
    return theta.sample_panel(spark, {"A11": (0.4, 0.9), "C11": (1.0, 1.0)}, {"Q11": (0.2, 0.6), "R11": (0.2, 0.6), "X0_1": (0.0, 0.0)}, units, 2, 5)


@query
def pfilter_steps(spark, sf):
    data, model = _daily(spark, sf)
    return inference.pfilter(data, model, theta.from_dicts(spark, [START]), particles=1000, reps=4)


@query
def pfilter_results(spark, sf):
    return results.filter_results(inference.logliks(pfilter_steps(spark, sf)))


@query
def panel_pfilter(spark, sf):
    data, model = _panel(spark, sf)
    steps = inference.pfilter(data, model, theta.from_dicts(spark, [START, START | {"A11": 0.5}]), particles=500, reps=3)
    return results.panel_results(inference.logliks(steps).withColumnRenamed("series_id", "unit"))


@query
def simulate_states(spark, sf):
    data, model = _daily(spark, sf)
    return inference.simulate(data, model, theta.from_dicts(spark, [START]), sims=20)[0]


@query
def simulate_observations(spark, sf):
    data, model = _daily(spark, sf)
    return inference.simulate(data, model, theta.from_dicts(spark, [START]), sims=20)[1]


@query
def simulate_probes(spark, sf):
    data, model = _daily(spark, sf)
    simulated = inference.simulate(data, model, theta.from_dicts(spark, [START]), sims=20)[1]
    real = _days(spark, sf).withColumnRenamed("y", "Y1")
    return results.probes(simulated, real, {"mean": F.avg("Y1"), "sd": F.stddev_samp("Y1")})


def _seasonal(spark, weeks: int = 26) -> tuple[DataFrame, DataFrame]:
    """A weekly grid of reports, and periodic B-splines on a grid of 0.01 years as covariates."""
    knots = spark.range(round(weeks / 52 / 0.01) + 21).select(F.lit("s").alias("series_id"), (F.col("id") * 0.01).alias("time"))
    basis = grid.periodic_bspline(F.col("time"), 3, 2, 1.0)
    return spark.range(1, weeks + 1).select(F.lit("s").alias("series_id"), (F.col("id") / 52).alias("time"), F.lit(10.0).alias("reports")), knots.select("series_id", "time", *[b.alias(f"seas_{i + 1}") for i, b in enumerate(basis)])


SIR = dict(gamma=26.0, mu=0.02, iota=0.01, beta1=400.0, beta2=480.0, beta3=320.0, beta_sd=0.01, pop=1e6, rho=0.1, k=0.1, S_0=0.065, I_0=0.001, R_0=0.934)


@query
def simulate_sir(spark, sf):
    weeks, seasons = _seasonal(spark)
    model = models.sir().tried(SIR)
    data = inference.packed(weeks, model, 0.0, covars=seasons, nstep=20)
    return inference.simulate(data, model, theta.from_dicts(spark, [SIR]), sims=10)[1]


@query
def pfilter_sir(spark, sf):
    weeks, seasons = _seasonal(spark)
    model = models.sir().tried(SIR)
    data = inference.packed(weeks, model, 0.0, covars=seasons, nstep=20)
    simulated = inference.as_series(inference.simulate(data, model, theta.from_dicts(spark, [SIR]), sims=1)[1])
    data = inference.packed(simulated, model, 0.0, covars=seasons, nstep=20)
    return results.filter_results(inference.logliks(inference.pfilter(data, model, theta.from_dicts(spark, [SIR]), particles=500, reps=4)))


@query
def pfilter_volatility(spark, sf):
    model = models.stochastic_volatility()
    start = dict(mu=0.0, kappa=0.1, theta=0.4, xi=0.2, rho=-0.3, V_0=0.4)
    returns = series.log_returns(_days(spark, sf).withColumn("close", F.exp("y")))
    data = inference.packed(returns, model.tried(start), 0.0, covars=series.lagged_covariate(returns), nstep=1, order="constant")
    return results.filter_results(inference.logliks(inference.pfilter(data, model, theta.from_dicts(spark, [start]), particles=500, reps=3)))


@query
def mif_traces(spark, sf):
    data, model = _daily(spark, sf)
    return inference.mif(data, model, _starts(spark), particles=300, iterations=15, perturbation=WALK)


@query
def panel_mif_blocked(spark, sf):
    data, model = _panel(spark, sf)
    return inference.panel_mif(data, model, *_panel_starts(spark, sf), particles=100, iterations=3, perturbation=WALK, block=True)


@query
def panel_mif_unblocked(spark, sf):
    data, model = _panel(spark, sf)
    return inference.panel_mif(data, model, *_panel_starts(spark, sf), particles=100, iterations=3, perturbation=WALK, block=False)


@query
def mop_loglik(spark, sf):
    data, model = _daily(spark, sf)
    return results.filter_results(inference.mop(data, model, theta.from_dicts(spark, [START]), particles=1000, reps=4))


@query
def covar_spline(spark, sf):
    by_unit = series.monthly_by_nation(spark, sf)
    return splines.smoothed(by_unit.select("series_id", (F.col("time") + 0.5).alias("t")), series.monthly_by_nation(spark, sf), "y", lam=5.0)


def _rates(m: int) -> np.ndarray:
    return learning_rates({"A11": 0.05, "Q11": 0.05, "R11": 0.05}, ["A11", "Q11", "R11"], m)


@query
def train_adam(spark, sf):
    data, model = _daily(spark, sf)
    return inference.train(data, model, _starts(spark, 2), particles=200, iterations=10, rates=_rates(10), names=["A11", "Q11", "R11"])


@query
def train_bfgs(spark, sf):
    data, model = _daily(spark, sf)
    return inference.train(data, model, _starts(spark, 2), particles=200, iterations=5, rates=_rates(5), names=["A11", "Q11", "R11"], optimizer="BFGS")


@query
def train_dpop_sir(spark, sf):
    weeks, seasons = _seasonal(spark, 10)
    model = models.sir().tried(SIR)
    data = inference.packed(weeks, model, 0.0, covars=seasons, nstep=5)
    rates = learning_rates({"rho": 0.05, "k": 0.05}, ["rho", "k"], 3)
    return inference.train(data, model, theta.from_dicts(spark, [SIR]), particles=100, iterations=3, rates=rates, names=["rho", "k"], dpop=True)


@query
def panel_train_sgd(spark, sf):
    data, model = _panel(spark, sf)
    return inference.panel_train(data, model, *_panel_starts(spark, sf), particles=50, iterations=2, rates=_rates(2), names=["A11", "Q11", "R11"], optimizer="SGD")


@query
def pmcmc_chains(spark, sf):
    data, model = _daily(spark, sf)
    return inference.pmcmc(data, model, theta.from_dicts(spark, [START]), particles=100, iterations=30, proposal=lambda: AdaptiveWalk({"A11": 0.05, "Q11": 0.05}), chains=3)


@query
def abc_chains(spark, sf):
    data, model = _daily(spark, sf)
    probes = {"sd": lambda y: float(np.std(y["Y1"])), "mean": lambda y: float(np.mean(y["Y1"]))}
    return inference.abc(data, model, theta.from_dicts(spark, [START]), iterations=50, proposal=lambda: DiagonalWalk({"A11": 0.05}), probes=probes, scale={"sd": 0.1, "mean": 0.2}, epsilon=3.0, chains=3)


def _profile_points(spark: SparkSession, sf: str, bins: int = 500) -> DataFrame:
    """(profile, parameter, loglik, n): all customers, as the means of equal ranges of the parameter, so that the profile's group is bounded."""
    customers = series.read_table(spark, sf, "customer")
    last = customers.agg(F.max("c_custkey").alias("k")).scalar()
    x = F.col("c_custkey") / last
    points = customers.select(F.least(F.floor(x * bins), F.lit(bins - 1)).alias("bin"), x.alias("parameter"), (-20 * (x - 0.4) * (x - 0.4) + F.col("c_acctbal") / 1e6).alias("loglik"))
    return points.groupBy("bin").agg(F.avg("parameter").alias("parameter"), F.avg("loglik").alias("loglik"), F.count("*").alias("n")).select(F.lit(0).alias("profile"), "parameter", "loglik", "n")


@query
def profile_interval(spark, sf):
    return profiles.profile_intervals(_profile_points(spark, sf), "profile")


@query
def benchmark_arma(spark, sf):
    return results.totals_first(profiles.benchmark(series.hourly_events(spark, sf), "n", "arma", log1p=True))


@query
def benchmark_negbin(spark, sf):
    return results.totals_first(profiles.benchmark(series.hourly_events(spark, sf), "n", "negbin"))


@query
def pfilter_yardstick(spark, sf):
    """The baseline's particles and replicates (5,000 and 30) over S1, against the exact loglik; bench.py times its 100 steps."""
    data, model = _daily(spark, sf)
    steps = inference.pfilter(data, model, theta.from_dicts(spark, [START]), particles=5000, reps=30)
    return results.filter_results(inference.logliks(steps))
