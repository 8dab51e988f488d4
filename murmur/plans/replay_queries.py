"""Particle algorithms with hashed draws, and model skeletons: queries whose SQL replays every draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import quantiles
from murmur.operators import inference, models, results, theta
from murmur.operators.kernels import Perturbation
from murmur.plans import particle_queries
from murmur.plans.particle_queries import START
from murmur.plans.sql_queries import S1, S2, rounded
from murmur.sources import series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_MASK = 4294967295


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _mix(xs: str) -> str:
    """The 32-bit mixing hash of every number of a list."""
    xs = f"list_transform({xs}, lambda v: (xor(v, v >> 16) * 2146121005::UBIGINT) & {_MASK}::UBIGINT)"
    xs = f"list_transform({xs}, lambda v: (xor(v, v >> 15) * 2221713035::UBIGINT) & {_MASK}::UBIGINT)"
    return f"list_transform({xs}, lambda v: xor(v, v >> 16))"


def _uniforms(key: str, call: str, n: int) -> str:
    """The list of a draw's n uniforms."""
    at = _mix(f"[(({key} + ({call})::UBIGINT * 2654435761::UBIGINT) & {_MASK}::UBIGINT)]")
    return f"list_transform({_mix(f'list_transform(range({n}), lambda j: ({at}[1] + j::UBIGINT * 2246822507::UBIGINT) & {_MASK}::UBIGINT)')}, lambda v: (v + 0.5) / 4294967296.0)"


def _normals(key: str, call: str, n: int) -> str:
    return f"list_transform(list_zip({_uniforms(key, call, n)}, {_uniforms(key, f'{call} + 1', n)}), lambda u: sqrt(-2 * ln(u[1])) * cos(2 * pi() * u[2]))"


def _key(*parts: str) -> str:
    return f"('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::UBIGINT"


def _sets(sets: list[dict]) -> str:
    """Parameter sets as rows (theta_idx, a, c, q, r, x0)."""
    rows = ", ".join(f"({i}, {t['A11']}::DOUBLE, {t['C11']}::DOUBLE, {t['Q11']}::DOUBLE, {t['R11']}::DOUBLE, {t['X0_1']}::DOUBLE)" for i, t in enumerate(sets))
    return f"sets(theta_idx, a, c, q, r, x0) AS (VALUES {rows})"


_PICK = "list_transform(range({n}), lambda m: x[least(len(list_filter(cs, lambda v: v <= (u + m) / {n})), {n} - 1) + 1])"


def _filter(source: str, sets: list[dict], reps: int, n: int, tail: str, seed: int = 1) -> str:
    """The bootstrap filter of the one-dimensional model as a recursion over times; ``source`` names o (series_id, i, time, y)."""
    return f"""WITH RECURSIVE {source}, {_sets(sets)},
jobs AS (SELECT series_id, theta_idx, rep, a, c, q, r, x0, {_key(f"'{seed}'", 'series_id', 'theta_idx::VARCHAR', 'rep::VARCHAR')} AS key FROM (SELECT DISTINCT series_id FROM o), sets, (SELECT unnest(range({reps})) AS rep)),
k(series_id, theta_idx, rep, a, c, q, r, key, i, time, xs, cll, ess, fm, pm) AS (
  SELECT series_id, theta_idx, rep, a, c, q, r, key, 0::BIGINT, 0.0::DOUBLE, list_transform({_normals('key', '0', n)}, lambda z: x0 + q * z), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM jobs
  UNION ALL
  SELECT series_id, theta_idx, rep, a, c, q, r, key, i, time, {_PICK.format(n=n)}, cll, ess, fm, pm FROM (
    SELECT *, list_transform(range(1, {n} + 1), lambda j: list_sum(e[1:j]) / list_sum(e)) AS cs, tot - ln({n}) AS cll, pow(list_sum(e), 2) / list_sum(list_transform(e, lambda v: v * v)) AS ess,
      list_sum(list_transform(list_zip(e, x), lambda p: p[1] * p[2])) / list_sum(e) AS fm, list_avg(x) AS pm
    FROM (
      SELECT *, mx + ln(list_sum(list_transform(lw, lambda v: exp(v - mx)))) AS tot, list_transform(lw, lambda v: exp(v - mx)) AS e FROM (
        SELECT *, list_max(lw) AS mx FROM (
          SELECT *, list_transform(x, lambda v: -0.5 * ln(2 * pi()) - ln(r) - 0.5 * pow((y - c * v) / r, 2)) AS lw FROM (
            SELECT k.series_id, theta_idx, rep, a, c, q, r, key, o.i, o.time, o.y, {_uniforms('key', 'o.i * 3 + 1', 1)}[1] AS u,
              list_transform(list_zip(xs, {_normals('key', 'o.i * 3 - 1', n)}), lambda p: a * p[1] + q * p[2]) AS x
            FROM k JOIN o ON o.series_id = k.series_id AND o.i = k.i + 1))))))
{tail}"""


_DAILY = f"{S1}, o AS (SELECT 'orders' AS series_id, row_number() OVER (ORDER BY time) AS i, time - min(time) OVER () + 1 AS time, y FROM s1)"
_MONTHLY = f"{S2}, o AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY time) AS i, time - min(time) OVER (PARTITION BY series_id) + 1 AS time, y - avg(y) OVER (PARTITION BY series_id) AS y FROM s2)"
PARTICLES, REPS = 64, 2
_PAIR = [START, START | {"A11": 0.5}]
_LME = "max(ll) + ln(avg(exp(ll - mx)))"


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    data, model = particle_queries._daily(spark, sf)
    return inference.pfilter(data, model, theta.from_dicts(spark, [START]), particles=PARTICLES, reps=REPS, draws="hash")


@query(_filter(_DAILY, [START], REPS, PARTICLES, "SELECT theta_idx, rep, time, round(cll, 5) AS cll, round(ess, 4) AS ess, round(fm, 5) AS filter_mean, round(pm, 5) AS prediction_mean FROM k WHERE i > 0"))
def pfilter_steps_replayed(spark, sf):
    one = lambda c: F.col(c)["X1"].alias(c)
    out = _steps(spark, sf).select("theta_idx", "rep", "time", "cll", "ess", one("filter_mean"), one("prediction_mean"))
    return out.select("theta_idx", "rep", "time", F.round("ess", 4).alias("ess"), *[F.round(c, 5).alias(c) for c in ("cll", "filter_mean", "prediction_mean")])


@query(_filter(_DAILY, [START], REPS, PARTICLES, f"SELECT theta_idx, round({_LME}, 4) AS loglik, round(abs(max(ll) - min(ll)) * 0 + (SELECT sqrt(count(*) - 1) * stddev_pop(j) FROM (SELECT ln((sum(exp(l.ll - m.mx)) OVER () - exp(l.ll - m.mx)) / (count(*) OVER () - 1)) AS j FROM t l, (SELECT max(ll) AS mx FROM t) m)), 4) AS se FROM (SELECT *, max(ll) OVER () AS mx FROM t) GROUP BY theta_idx").replace("SELECT theta_idx, round(max(ll)", ", t AS (SELECT theta_idx, rep, sum(cll) AS ll FROM k WHERE i > 0 GROUP BY 1, 2) SELECT theta_idx, round(max(ll)"))
def pfilter_results_replayed(spark, sf):
    return rounded(results.filter_results(inference.logliks(_steps(spark, sf))), 4)


@query(_filter(_MONTHLY, _PAIR, 3, PARTICLES, ", t AS (SELECT series_id, theta_idx, rep, sum(cll) AS ll FROM k WHERE i > 0 GROUP BY ALL), m AS (SELECT *, max(ll) OVER (PARTITION BY series_id, theta_idx) AS mx FROM t), j AS (SELECT *, ln((sum(exp(ll - mx)) OVER w - exp(ll - mx)) / 2) AS j FROM m WINDOW w AS (PARTITION BY series_id, theta_idx)), u AS (SELECT series_id, theta_idx, max(ll) + ln(avg(exp(ll - mx))) AS ull, sqrt(2) * stddev_pop(j) AS use FROM j GROUP BY ALL) SELECT theta_idx, series_id AS unit, round(ull, 4) AS unit_loglik, round(use, 4) AS unit_se, round(sum(ull) OVER (PARTITION BY theta_idx), 3) AS shared_loglik, round(sqrt(sum(use * use) OVER (PARTITION BY theta_idx)), 4) AS shared_se FROM u"))
def panel_pfilter_replayed(spark, sf):
    data, model = particle_queries._panel(spark, sf)
    steps = inference.pfilter(data, model, theta.from_dicts(spark, _PAIR), particles=PARTICLES, reps=3, draws="hash")
    out = results.panel_results(inference.logliks(steps).withColumnRenamed("series_id", "unit"))
    return out.select("theta_idx", "unit", *[F.round(c, 4).alias(c) for c in ("unit_loglik", "unit_se", "shared_se")], F.round("shared_loglik", 3).alias("shared_loglik"))


SIMS, CHUNK = 30, 20


def _simulation(tail: str) -> str:
    """Paths in chunks: the start, then for each time a normal for the state and one for the observation."""
    p = START
    return f"""WITH RECURSIVE {_DAILY}, jobs AS (SELECT chunk, {_key("'1'", "'orders'", "'0'", 'chunk::VARCHAR')} AS key FROM (SELECT unnest(range({-(-SIMS // CHUNK)})) AS chunk)),
k(chunk, key, i, time, xs, ys) AS (
  SELECT chunk, key, 0::BIGINT, 0.0::DOUBLE, list_transform({_normals('key', '0', CHUNK)}, lambda z: {p['X0_1']} + {p['Q11']} * z), []::DOUBLE[] FROM jobs
  UNION ALL
  SELECT chunk, key, i, time, x, list_transform(list_zip(x, {_normals('key', 'i * 4', CHUNK)}), lambda v: {p['C11']} * v[1] + {p['R11']} * v[2]) FROM (
    SELECT chunk, key, o.i, o.time, list_transform(list_zip(xs, {_normals('key', 'o.i * 4 - 2', CHUNK)}), lambda v: {p['A11']} * v[1] + {p['Q11']} * v[2]) AS x FROM k JOIN o ON o.i = k.i + 1))
{tail}"""


def _paths(spark, sf):
    data, model = particle_queries._daily(spark, sf)
    return inference.simulate(data, model, theta.from_dicts(spark, [START]), sims=SIMS, chunk=CHUNK, draws="hash")


@query(_simulation(f"SELECT sim, time, round(x, 5) AS x FROM (SELECT chunk * {CHUNK} + unnest(range({CHUNK})) AS sim, time, unnest(xs) AS x FROM k) WHERE sim < {SIMS}"))
def simulate_states_replayed(spark, sf):
    return _paths(spark, sf)[0].select(F.col("sim").cast("bigint").alias("sim"), "time", F.round("X1", 5).alias("x"))


@query(_simulation(f"SELECT sim, time, round(y, 5) AS y FROM (SELECT chunk * {CHUNK} + unnest(range({CHUNK})) AS sim, time, unnest(ys) AS y FROM k WHERE i > 0) WHERE sim < {SIMS}"))
def simulate_observations_replayed(spark, sf):
    return _paths(spark, sf)[1].select(F.col("sim").cast("bigint").alias("sim"), "time", F.round("Y1", 5).alias("y"))


@query(_simulation(f", y AS (SELECT * FROM (SELECT chunk * {CHUNK} + unnest(range({CHUNK})) AS sim, unnest(ys) AS y FROM k WHERE i > 0) WHERE sim < {SIMS}), s AS (SELECT sim, avg(y) AS mean, stddev_samp(y) AS sd FROM y GROUP BY 1), d AS (SELECT avg(y) AS mean, stddev_samp(y) AS sd FROM o) SELECT probe, round(value, 5) AS value, false AS is_real_data, 0 AS theta_idx, sim FROM (UNPIVOT s ON mean, sd INTO NAME probe VALUE value) UNION ALL SELECT probe, round(value, 5), true, NULL, NULL FROM (UNPIVOT d ON mean, sd INTO NAME probe VALUE value)"))
def simulate_probes_replayed(spark, sf):
    real = particle_queries._days(spark, sf).withColumnRenamed("y", "Y1")
    out = results.probes(_paths(spark, sf)[1], real, {"mean": F.avg("Y1"), "sd": F.stddev_samp("Y1")})
    return rounded(out, 5).withColumn("sim", F.col("sim").cast("bigint"))


_SHIPMENTS = """s4 AS (SELECT 'shipments' AS series_id, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::DOUBLE AS time, ln(sum(l_quantity)) AS y FROM lineitem GROUP BY ALL),
o AS (SELECT series_id, row_number() OVER (ORDER BY time) AS i, time - min(time) OVER () + 1 AS time, y - avg(y) OVER () AS y FROM s4)"""
MIF_STARTS = [START, START | {"A11": 0.5, "Q11": 0.6}]
MIF_ITERATIONS = 10


def _months(spark, sf):
    model = models.linear_gaussian()
    shipped = series.monthly_shipments(spark, sf)
    moments = shipped.agg(F.avg("y").alias("m"), F.min("time").alias("t")).first()
    centred = shipped.select("series_id", (F.col("time") - moments.t + 1).alias("time"), (F.col("y") - moments.m).alias("Y1"))
    return inference.packed(centred, model, 0.0, nstep=1), model


def _mif() -> str:
    """Iterated filtering as one recursion over all iterations' times: three walks, a state's shock and a uniform a time; a start of its own an iteration."""
    n, s = PARTICLES, 0.02
    per = "(2 + 9 * nt)"  # draws an iteration: the start's pair, then four pairs and a uniform a time
    base = f"m * {per} + 2 + (i - 1) * 9"
    moved = lambda est, k: f"list_transform(list_zip({est}, {_normals('key', f'{base} + {2 * k}', n)}), lambda p: p[1] + f * {s} * p[2])"
    pick = lambda xs: _PICK.format(n=n).replace("x[", f"{xs}[")
    sets = ", ".join(f"({i}, {t['A11']}::DOUBLE, {t['Q11']}::DOUBLE, {t['R11']}::DOUBLE)" for i, t in enumerate(MIF_STARTS))
    flat = lambda v: f"list_transform(range({n}), lambda j: {v})"
    return f"""WITH RECURSIVE {_SHIPMENTS}, size AS (SELECT count(*) AS nt FROM o), sets(theta_idx, a0, q0, r0) AS (VALUES {sets}),
k(theta_idx, key, nt, m, i, ea, eq, er, xs, ll, done) AS (
  SELECT theta_idx, {_key("'1'", "'shipments'", 'theta_idx::VARCHAR', "'0'")}, nt, 0::BIGINT, 0::BIGINT, {flat('a0')}, {flat('ln(q0)')}, {flat('ln(r0)')}, []::DOUBLE[], 0.0::DOUBLE, false FROM sets, size
  UNION ALL
  SELECT theta_idx, key, nt, CASE WHEN i = nt THEN m + 1 ELSE m END, CASE WHEN i = nt THEN 0 ELSE i END, {pick('pa')}, {pick('pq')}, {pick('pr')}, {pick('x')}, lp + cll, i = nt FROM (
    SELECT *, list_transform(range(1, {n} + 1), lambda j: list_sum(e[1:j]) / list_sum(e)) AS cs, mx + ln(list_sum(e)) - ln({n}) AS cll FROM (
      SELECT *, list_transform(lw, lambda v: exp(v - mx)) AS e FROM (
        SELECT *, list_max(lw) AS mx FROM (
          SELECT *, list_transform(list_zip(x, pr, range({n})), lambda p: -0.5 * ln(2 * pi()) - p[2] - 0.5 * pow((y - p[1]) / exp(p[2]), 2)) AS lw FROM (
            SELECT *, list_transform(list_zip(x0s, pa, pq, {_normals('key', f'{base} + 6', n)}), lambda p: p[1] * p[2] + exp(p[3]) * p[4]) AS x FROM (
              SELECT *, {moved('ea', 0)} AS pa, {moved('eq', 1)} AS pq, {moved('er', 2)} AS pr, {_uniforms('key', f'{base} + 8', 1)}[1] AS u FROM (
                SELECT theta_idx, key, k.nt, m, o.i, o.y, ea, eq, er, CASE WHEN k.i = 0 THEN 0.0 ELSE ll END AS lp, pow(0.5, ((o.i - 1)::DOUBLE / k.nt + m) / 20) AS f,
                  CASE WHEN k.i = 0 THEN list_transform(list_zip(eq, {_normals('key', f'm * {per}', n)}), lambda p: exp(p[1]) * p[2]) ELSE xs END AS x0s
                FROM k JOIN o ON o.i = k.i + 1 WHERE m < {MIF_ITERATIONS}))))))))
SELECT theta_idx, m AS iteration, round(CASE WHEN m = 0 THEN NULL ELSE ll END, 4) AS loglik, round(list_avg(ea), 5) AS a, round(exp(list_avg(eq)), 5) AS q, round(exp(list_avg(er)), 5) AS r FROM k WHERE done OR (m = 0 AND i = 0)"""


@query(_mif())
def mif_traces_replayed(spark, sf):
    data, model = _months(spark, sf)
    walk = Perturbation({"A11": 0.02, "Q11": 0.02, "R11": 0.02}, cooling=lambda frac: 0.5 ** (frac / 20))
    out = inference.mif(data, model, theta.from_dicts(spark, MIF_STARTS), particles=PARTICLES, iterations=MIF_ITERATIONS, perturbation=walk, draws="hash")
    return out.select("theta_idx", F.col("iteration").cast("bigint").alias("iteration"), F.round(F.nanvl("loglik", F.lit(None).cast("double")), 4).alias("loglik"), F.round("A11", 5).alias("a"), F.round("Q11", 5).alias("q"), F.round("R11", 5).alias("r"))


CHOLERA = {"gamma": 20.8, "m": 0.06, "rho": 0.5, "epsilon": 19.1, "c": 0.4, "beta_trend": -0.00498, "sigma": 3.13, "tau": 0.23, "alpha": 0.9, "delta": 0.02, "S_0": 0.6, "I_0": 0.3, "Y_0": 0.05, "R1_0": 0.02, "R2_0": 0.02, "R3_0": 0.01} | {f"bs{i}": v for i, v in enumerate((0.747, 6.38, -3.44, 4.23, 3.33, 4.55), 1)} | {f"omegas{i}": v for i, v in enumerate((-1.69, -2.54, -2.84, -4.69, -8.48, -4.39), 1)}


def _cholera_rows(spark, sf):
    """States and covariates of a step from every customer."""
    x = F.col("c_custkey") % 97 + 1
    customers = series.read_table(spark, sf, "customer")
    states = {"S": 50.0 + x, "I": 0.5 * x, "Y": 0.1 * x, "R1": 0.02 * x, "R2": F.lit(0.4), "R3": 0.3 + 0 * x, "Mn": 0.01 * x, "count": 0.0 * x}
    covars = {"trend": x / 97, "dpopdt": F.lit(-2.0), "pop": 200.0 + x} | {f"seas{i}": F.when(x % 6 == i - 1, 1.0).otherwise(0.0) for i in range(1, 7)}
    return customers.select("c_custkey", *[v.alias(k) for k, v in (states | covars).items()])


def _cholera_sql() -> str:
    p = CHOLERA
    bs, om = (f"(CASE (x % 6) {' '.join(f'WHEN {i - 1} THEN {p[f'{n}{i}']}' for i in range(1, 7))} END)" for n in ("bs", "omegas"))
    dt = 1 / 240
    clip = lambda e: f"round(greatest({e}, 0), 6)"
    moved = {
        "S": f"s + (-2.0 + {p['delta']} * pop - inf - {p['delta']} * s + 3 * {p['epsilon']} * r3 + {p['rho']} * y) * {dt}",
        "I": f"i + ({p['c']} * inf - {p['m']} * i - {p['delta']} * i - {p['gamma']} * i) * {dt}",
        "Y": f"y + ((1 - {p['c']}) * inf - {p['delta']} * y - {p['rho']} * y) * {dt}",
        "R1": f"r1 + ({p['gamma']} * i - 3 * {p['epsilon']} * r1 - {p['delta']} * r1) * {dt}",
        "R2": f"r2 + (3 * {p['epsilon']} * r1 - 3 * {p['epsilon']} * r2 - {p['delta']} * r2) * {dt}",
        "R3": f"r3 + (3 * {p['epsilon']} * r2 - 3 * {p['epsilon']} * r3 - {p['delta']} * r3) * {dt}",
        "Mn": f"mn + {p['m']} * i * {dt}",
    }
    below = " OR ".join(f"{e} < 0" for e in moved.values())
    return f"""WITH x AS (SELECT c_custkey, (c_custkey % 97 + 1)::DOUBLE AS x FROM customer),
v AS (SELECT c_custkey, x, 50 + x AS s, 0.5 * x AS i, 0.1 * x AS y, 0.02 * x AS r1, 0.4::DOUBLE AS r2, 0.3::DOUBLE AS r3, 0.01 * x AS mn, 200 + x AS pop FROM x),
f AS (SELECT *, (exp({om}) + exp({p['beta_trend']} * x / 97 + {bs}) * pow(i / pop, {p['alpha']})) * s AS inf FROM v)
SELECT c_custkey, {', '.join(f'{clip(e)} AS "{k}"' for k, e in moved.items())}, ({below})::INT::DOUBLE AS count FROM f"""


@query(_cholera_sql())
def cholera_skeleton(spark, sf):
    """A step of the cholera model without its noise; the gamma form has the same skeleton."""
    return rounded(inference.skeleton(_cholera_rows(spark, sf), models.cholera(), CHOLERA, time=0.0, dt=1 / 240, keys=["c_custkey"]), 6)


@query(_cholera_sql())
def cholera_gamma_skeleton(spark, sf):
    return rounded(inference.skeleton(_cholera_rows(spark, sf), models.cholera("gamma"), CHOLERA, time=0.0, dt=1 / 240, keys=["c_custkey"]), 6)


MEASLES = {"R0": 56.8, "sigma": 28.9, "gamma": 30.4, "iota": 2.9, "iota1": 0.3, "iota2": 0.7, "rho": 0.488, "sigmaSE": 0.0878, "psi": 0.116, "cohort": 0.557, "amplitude": 0.554, "mu": 0.03, "alpha": 0.976, "S_0": 0.03, "E_0": 0.0001, "I_0": 0.0001, "R_0": 0.97}
#: A holiday in which a cohort enters school, and a day of term.
_ENTRY, _TERM = 1950 + 251.0 / 365.0, 1950 + 120 / 365.25
_DT = 1 / 365.25


def _measles_sql() -> str:
    """Expected flows of every variant at both times; logw is left to the tests."""
    p, out = MEASLES, []
    soft = lambda e: f"(greatest(100 * ({e}), 0) + ln(1 + exp(-abs(100 * ({e}))))) / 100"
    for variant in models.MEASLES:
        mu, mix = (p["mu"], p["alpha"]) if variant == "001" else (0.02, 1.0)
        brought = f"exp({p['iota1']} + {p['iota2']} * z)" if variant.startswith("002") else str(p["iota"])
        for entry, season in ((True, 1 - p["amplitude"]), (False, 1 + p["amplitude"] * 0.2411 / 0.7589)):
            births = f"{p['cohort'] if entry else 0} * rate + (1 - {p['cohort']}) * rate * {_DT}::DOUBLE"
            force = f"{p['R0'] * season / _DT}::DOUBLE * (1 - exp(-{(p['gamma'] + mu) * _DT}::DOUBLE)) * pow(i + {brought}, {mix}) / pop"
            if variant == "003":
                flow = f"SELECT c_custkey, s, e, i, pop, rate, c, {soft(births)} AS b, f * s * {_DT}::DOUBLE AS se, {mu} * s * {_DT}::DOUBLE AS sd, {p['sigma']}::DOUBLE * e * {_DT}::DOUBLE AS ei, {mu} * e * {_DT}::DOUBLE AS ed, {p['gamma']} * i * {_DT}::DOUBLE AS ir, {mu} * i * {_DT}::DOUBLE AS ig"
                s, e, i, c = soft("s + b - se - sd"), soft("e + se - ei - ed"), soft("i + ei - ir - ig"), soft("c + ei")
            else:
                leave = lambda n, r, d: f"{n} * (1 - exp(-({r} + {mu}) * {_DT}::DOUBLE)) * ({d}) / ({r} + {mu})"
                flow = f"SELECT c_custkey, s, e, i, pop, rate, c, {births} AS b, {leave('s', 'f', 'f')} AS se, {leave('s', 'f', mu)} AS sd, {leave('e', p['sigma'], p['sigma'])} AS ei, {leave('e', p['sigma'], mu)} AS ed, {leave('i', p['gamma'], p['gamma'])} AS ir, {leave('i', p['gamma'], mu)} AS ig"
                s, e, i, c = "s + b - se - sd", "e + se - ei - ed", "i + ei - ir - ig", "c + ir"
            rest = soft(f"pop - {s} - {e} - {i}") if variant == "003" else f"pop - ({s}) - ({e}) - ({i})"
            out.append(f"SELECT c_custkey, '{variant}' AS variant, {str(entry).lower()} AS entry, round({s}, 5) AS \"S\", round({e}, 5) AS \"E\", round({i}, 5) AS \"I\", round({rest}, 4) AS \"R\", round({c}, 5) AS \"C\" FROM ({flow} FROM (SELECT *, {force} AS f FROM v))")
    return f"""WITH x AS (SELECT c_custkey, (c_custkey % 89)::DOUBLE AS x FROM customer),
v AS (SELECT c_custkey, 3000 + 10 * x AS s, 40 + x AS e, 30 + x AS i, 5 + x AS c, 100000 + 100 * x AS pop, 2000 + x AS rate, (x - 44) / 25 AS z FROM x) {' UNION ALL '.join(out)}"""


@query(_measles_sql())
def measles_skeletons(spark, sf):
    """A step of every measles variant, all draws at their expectations, in a holiday of school entry and in term."""
    x = (F.col("c_custkey") % 89).cast("double")
    rows = series.read_table(spark, sf, "customer").select("c_custkey", (3000 + 10 * x).alias("S"), (40 + x).alias("E"), (30 + x).alias("I"), (5 + x).alias("C"), F.lit(0.0).alias("R"), F.lit(0.0).alias("W"), F.lit(0.0).alias("logw"), (100000 + 100 * x).alias("pop"), (2000 + x).alias("birthrate"), ((x - 44) / 25).alias("std_log_pop_1950"))
    out = None
    for variant in models.MEASLES:
        for entry, time in ((True, _ENTRY), (False, _TERM)):
            one = inference.skeleton(rows, models.measles(variant), MEASLES, time=time, dt=_DT, keys=["c_custkey"])
            one = one.select("c_custkey", F.lit(variant).alias("variant"), F.lit(entry).alias("entry"), *[F.round(c, 4 if c == "R" else 5).alias(c) for c in "SEIRC"])
            out = one if out is None else out.unionByName(one)
    return out


SIR = particle_queries.SIR


def _sir_sql() -> str:
    p, dt = SIR, 1 / 1040
    leave = lambda n, r, d: f"{n} * (1 - exp(-({r} + {p['mu']}) * {dt})) * ({d}) / ({r} + {p['mu']})"
    return f"""WITH x AS (SELECT c_custkey, (c_custkey % 50)::DOUBLE AS x FROM customer), v AS (SELECT c_custkey, 60000 + 10 * x AS s, 900 + x AS i, 900000 + x AS r, x AS cases, x / 100 AS a, 0.5 - x / 200 AS b FROM x),
f AS (SELECT *, ({p['iota']} + ({p['beta1']} * a + {p['beta2']} * b + {p['beta3']} * (0.5 - x2)) * i) / {p['pop']} AS f FROM (SELECT *, a / 2 AS x2 FROM v))
SELECT c_custkey, round(s + {p['mu']} * {p['pop']} * {dt} - ({leave('s', 'f', 'f')}) - ({leave('s', 'f', p['mu'])}), 5) AS "S", round(i + {leave('s', 'f', 'f')} - ({leave('i', p['gamma'], p['gamma'])}) - ({leave('i', p['gamma'], p['mu'])}), 5) AS "I",
  round(r + {leave('i', p['gamma'], p['gamma'])} - r * (1 - exp(-{p['mu']} * {dt})), 4) AS "R", round(cases + {leave('i', p['gamma'], p['gamma'])}, 5) AS cases FROM f"""


@query(_sir_sql())
def sir_skeleton(spark, sf):
    x = (F.col("c_custkey") % 50).cast("double")
    rows = series.read_table(spark, sf, "customer").select("c_custkey", (60000 + 10 * x).alias("S"), (900 + x).alias("I"), (900000 + x).alias("R"), x.alias("cases"), F.lit(0.0).alias("W"), F.lit(0.0).alias("logw"), (x / 100).alias("seas_1"), (0.5 - x / 200).alias("seas_2"), (0.5 - x / 200).alias("seas_3"))
    out = inference.skeleton(rows, models.sir(), SIR, time=0.0, dt=1 / 1040, keys=["c_custkey"])
    return out.select("c_custkey", *[F.round(c, 4 if c == "R" else 5).alias(c) for c in ("S", "I", "R", "cases")])


@query(_filter(_DAILY, [START], REPS, PARTICLES, "SELECT theta_idx, rep, round(sum(cll), 4) AS loglik FROM k WHERE i > 0 GROUP BY 1, 2"))
def mop_loglik_replayed(spark, sf):
    """Off-parameter weights are one in value where the parameters are the filter's own: the likelihood is the bootstrap filter's."""
    data, model = particle_queries._daily(spark, sf)
    out = inference.mop(data, model, theta.from_dicts(spark, [START]), particles=PARTICLES, reps=REPS, draws="hash")
    return out.select("theta_idx", "rep", F.round("loglik", 4).alias("loglik"))


@query(_filter(_MONTHLY, _PAIR, 2, PARTICLES, "SELECT theta_idx, rep, round(sum(cll), 3) AS loglik FROM k WHERE i > 0 GROUP BY 1, 2"))
def panel_mop_replayed(spark, sf):
    data, model = particle_queries._panel(spark, sf)
    out = inference.panel_mop(data, model, theta.from_dicts(spark, _PAIR), particles=PARTICLES, reps=2, draws="hash")
    return out.select("theta_idx", "rep", F.round("loglik", 3).alias("loglik"))


_DESCENTS = {"SGD": {}, "Adam": {}, "FullMatrixAdam": {}, "BFGS": {}, "Newton": {}, "WeightedNewton": {}, "Armijo": {"line_search": True}}
_STEPS, _RATE = 8, 0.1


def _descent_sql() -> str:
    """All optimizers on k (x - 1)^2 / 2 + x^4 / 4, a column a state."""
    f = lambda x: f"(0.5 * kk * pow({x} - 1, 2) + 0.25 * pow({x}, 4))"
    weight = "CASE WHEN i = 0 THEN 0.0 ELSE pow(i + 1, ln(i + 1)) / pow(i + 2, ln(i + 2)) END"
    return f"""WITH RECURSIVE starts AS (SELECT DISTINCT c_custkey % 20 AS a, c_custkey % 7 AS b FROM customer),
names AS (SELECT unnest([{', '.join(f"'{n}'" for n in _DESCENTS)}]) AS optimizer),
t(optimizer, a, b, kk, i, x, m, v, inv, gp, sp, hm) AS (
  SELECT optimizer, a, b, (1 + b)::DOUBLE, 0, a / 10.0::DOUBLE - 1.03, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM starts, names
  UNION ALL
  SELECT optimizer, a, b, kk, i + 1, x + st, m2, v2, inv2, g, st, hm2 FROM (
    SELECT *, CASE WHEN optimizer = 'Armijo' THEN {_RATE} * pow(0.5, coalesce(list_filter(range(10), lambda j: {f('(x + ' + str(_RATE) + ' * pow(0.5, j) * d)')} <= {f('x')} + {_RATE} * pow(0.5, j) * 0.1 * g * d)[1], 10)) * d ELSE {_RATE} * d END AS st FROM (
      SELECT *, CASE WHEN optimizer IN ('SGD', 'Armijo') THEN -g
        WHEN optimizer = 'Adam' THEN -(m2 / (1 - pow(0.9, i + 1))) / (sqrt(v2 / (1 - pow(0.999, i + 1))) + 1e-8)
        WHEN optimizer = 'FullMatrixAdam' THEN -(m2 / (1 - pow(0.9, i + 1))) / (sqrt(greatest(v2 / (1 - pow(0.999, i + 1)), 0)) + 1e-4)
        WHEN optimizer = 'BFGS' THEN -inv2 * g WHEN optimizer = 'Newton' THEN -g / h ELSE -g / hm2 END AS d
      FROM (SELECT *, 0.9 * m + 0.1 * g AS m2, 0.999 * v + 0.001 * g * g AS v2, CASE WHEN i > 0 AND sp * (g - gp) > 1e-12 THEN sp / (g - gp) ELSE inv END AS inv2, ({weight}) * hm + (1 - ({weight})) * h AS hm2
        FROM (SELECT *, kk * (x - 1) + pow(x, 3) AS g, kk + 3 * x * x AS h FROM t WHERE i < {_STEPS}))))
)
SELECT optimizer, a, b, i AS step, round(x, 6) AS x FROM t WHERE i > 0"""


@query(_descent_sql())
def optimizer_paths(spark, sf):
    """Eight steps of every optimizer from many starts, on functions of many curvatures."""
    starts = series.read_table(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("a"), (F.col("c_custkey") % 7).alias("b")).distinct().withColumn("x", F.col("a") / 10 - 1.03)
    out = None
    for name, settings in _DESCENTS.items():
        path = inference.descent(
            starts, "SGD" if name == "Armijo" else name,
            lambda x, r: (1 + r["b"]) * (x - 1) + x**3, lambda x, r: 1 + r["b"] + 3 * x * x, lambda x, r: 0.5 * (1 + r["b"]) * (x - 1) ** 2 + 0.25 * x**4,
            steps=_STEPS, rate=_RATE, keys=["a", "b"], **settings,
        ).select(F.lit(name).alias("optimizer"), "a", "b", "step", F.round("x", 6).alias("x"))
        out = path if out is None else out.unionByName(path)
    return out


def _by_batch(df: DataFrame, columns: dict[str, str], f) -> DataFrame:
    """(l_orderkey, l_linenumber, columns...): ``f(frame)`` -> arrays, batch by batch."""
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"l_orderkey": frame.l_orderkey, "l_linenumber": frame.l_linenumber} | f(frame))

    return df.mapInPandas(run, "l_orderkey bigint, l_linenumber int, " + ", ".join(f"{c} {kind}" for c, kind in columns.items()))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS y, l_extendedprice / 1000 + 1 AS mu, 1 / (0.1 + l_discount) AS size, l_quantity AS n, l_discount + 0.01 AS r1, l_tax + 0.02 AS r2, floor(l_quantity / 4) AS g1, floor(l_quantity / 8) AS g2 FROM lineitem),
p AS (SELECT *, (1 - exp(-(r1 + r2) * 0.5)) * r1 / (r1 + r2) AS p1, (1 - exp(-(r1 + r2) * 0.5)) * r2 / (r1 + r2) AS p2 FROM l)
SELECT l_orderkey, l_linenumber, round(lgamma(y + size) - lgamma(size) - lgamma(y + 1) + size * ln(size / (size + mu)) + y * ln(mu / (size + mu)), 6) AS nbinom,
  round(lgamma(n + 1) - lgamma(n - g1 - g2 + 1) - lgamma(g1 + 1) - lgamma(g2 + 1) + CASE WHEN n - g1 - g2 > 0 THEN (n - g1 - g2) * ln(1 - p1 - p2) ELSE 0 END + CASE WHEN g1 > 0 THEN g1 * ln(p1) ELSE 0 END + CASE WHEN g2 > 0 THEN g2 * ln(p2) ELSE 0 END, 6) AS exits,
  round((greatest(100 * (l.mu - 50), 0) + ln(1 + exp(-abs(100 * (l.mu - 50))))) / 100 + 50, 6) AS soft
FROM p l""")
def measure_densities(spark, sf):
    """Negative-binomial and Euler-multinomial log densities, and the soft clamp, of every line."""
    def densities(x):
        rates, size = [x.l_discount.to_numpy() + 0.01, x.l_tax.to_numpy() + 0.02], 1 / (0.1 + x.l_discount.to_numpy())
        q, mu = x.l_quantity.to_numpy(), x.l_extendedprice.to_numpy() / 1000 + 1
        found = {"nbinom": models.nbinom_logpmf(q, mu, size), "exits": models.exits_logpmf(q, [np.floor(q / 4), np.floor(q / 8)], rates, 0.5), "soft": models.softened(mu, 50.0)}
        return found

    return rounded(_by_batch(series.read_table(spark, sf, "lineitem"), {"nbinom": "double", "exits": "double", "soft": "double"}, densities))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS lam, floor(l_quantity) AS n, 0.05 + l_discount * 5 AS p, (l_partkey % 1000 + 0.5) / 1000.0 AS u FROM lineitem),
d AS (SELECT DISTINCT lam, n, p, u FROM l),
k AS (SELECT lam, n, p, u, k, sum(exp(k * ln(lam) - lam - lgamma(k + 1))) OVER w AS pc, CASE WHEN k <= n THEN sum(CASE WHEN k <= n THEN exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - least(k, n) + 1) + k * ln(p) + (n - k) * ln(1 - p)) END) OVER w END AS bc FROM d, (SELECT unnest(range(131))::DOUBLE AS k) WINDOW w AS (PARTITION BY lam, n, p, u ORDER BY k)),
q AS (SELECT lam, n, p, u, min(k) FILTER (pc >= u) AS poisson, coalesce(min(k) FILTER (bc >= u), any_value(n)) AS binomial FROM k GROUP BY lam, n, p, u)
SELECT l_orderkey, l_linenumber, poisson::BIGINT AS poisson, binomial::BIGINT AS binomial FROM l JOIN q USING (lam, n, p, u)""")
def quantile_draws(spark, sf):
    """Poisson and binomial draws as quantiles of a uniform, for every line."""
    def drawn(x):
        u = (x.l_partkey.to_numpy() % 1000 + 0.5) / 1000.0
        return {"poisson": quantiles.poisson(u, x.l_quantity), "binomial": quantiles.binomial(u, np.floor(x.l_quantity), 0.05 + x.l_discount * 5)}

    return _by_batch(series.read_table(spark, sf, "lineitem"), {"poisson": "bigint", "binomial": "bigint"}, drawn)


_TRACED = "b AS (SELECT (o_custkey % 10)::INT AS theta_idx, o_orderpriority AS unit, (year(o_orderdate) - 1992)::INT AS iteration, max(o_totalprice) AS loglik, count(*)::DOUBLE AS own FROM orders GROUP BY ALL), w AS (SELECT theta_idx, iteration, round(sum(loglik), 2) AS loglik, sum(own) AS shared FROM b GROUP BY ALL)"


def _panel_traced(spark, sf):
    orders = series.read_table(spark, sf, "orders")
    units = orders.groupBy((F.col("o_custkey") % 10).cast("int").alias("theta_idx"), F.col("o_orderpriority").alias("unit"), (F.year("o_orderdate") - 1992).alias("iteration")).agg(F.max("o_totalprice").alias("loglik"), F.count("*").cast("double").alias("own"))
    whole = units.groupBy("theta_idx", "iteration").agg(F.round(F.sum("loglik"), 2).alias("loglik"), F.sum("own").alias("shared"))
    none = F.lit(None).cast("double")
    return units.withColumn("shared", none).unionByName(whole.withColumns({"unit": F.lit("shared"), "own": none}))


@query(f"WITH {_TRACED} SELECT theta_idx, 'shared' AS unit, iteration, 'mif' AS method, loglik, NULL::DOUBLE AS se, NULL AS own, shared FROM w UNION ALL SELECT theta_idx, unit, iteration, 'mif', b.loglik, NULL, own, shared FROM b JOIN w USING (theta_idx, iteration)")
def panel_estimate_traces(spark, sf):
    return results.panel_estimate_traces(_panel_traced(spark, sf), ["shared"], "mif")


@query(f"WITH {_TRACED}, l AS (SELECT theta_idx, max(iteration) AS iteration FROM b GROUP BY 1) SELECT theta_idx, iteration, w.loglik AS shared_loglik, NULL::DOUBLE AS shared_se, unit, b.loglik AS unit_loglik, NULL::DOUBLE AS unit_se, own, shared FROM l JOIN b USING (theta_idx, iteration) JOIN w USING (theta_idx, iteration)")
def panel_estimate_view(spark, sf):
    return results.panel_estimate_view(_panel_traced(spark, sf), ["shared"])


@query(f"WITH {_TRACED} SELECT theta_idx, max_by(loglik, iteration) AS loglik, NULL::DOUBLE AS se, max_by(shared, iteration) AS shared FROM w GROUP BY 1")
def estimate_view(spark, sf):
    return results.estimate_view(_panel_traced(spark, sf).where("unit = 'shared'").drop("unit", "own"))


@query(f"WITH {_TRACED} SELECT theta_idx, iteration, 'train' AS method, loglik, NULL::DOUBLE AS se, shared FROM w")
def estimate_traces(spark, sf):
    return results.estimate_traces(_panel_traced(spark, sf).where("unit = 'shared'").drop("unit", "own"), "train")


@query(f"WITH {_TRACED} SELECT theta_idx, unit, iteration, 'abc' AS method, NULL::DOUBLE AS loglik, NULL::DOUBLE AS se, loglik AS distance, own FROM b")
def chain_traces(spark, sf):
    chains = _panel_traced(spark, sf).where("unit <> 'shared'").drop("shared").withColumnRenamed("loglik", "distance")
    return results.chain_traces(chains, "abc")


_LOGLIKS = "r AS (SELECT (o_custkey % 10)::INT AS theta_idx, o_orderpriority AS unit, o_orderkey AS rep, -o_totalprice / 20000 AS ll FROM orders), m AS (SELECT *, max(ll) OVER p AS mx, count(*) OVER p AS n FROM r WINDOW p AS (PARTITION BY {by})), s AS (SELECT *, sum(exp(ll - mx)) OVER (PARTITION BY {by}) AS t FROM m), j AS (SELECT *, ln((t - exp(ll - mx)) / (n - 1)) AS j FROM s), u AS (SELECT {by}, any_value(mx + ln(t / n)) AS lme, sqrt(any_value(n) - 1) * stddev_pop(j) AS se FROM j GROUP BY {by})"


def _loglik_rows(spark, sf):
    return series.read_table(spark, sf, "orders").select((F.col("o_custkey") % 10).cast("int").alias("theta_idx"), F.col("o_orderpriority").alias("unit"), F.col("o_orderkey").alias("rep"), (-F.col("o_totalprice") / 20000).alias("loglik"))


@query(f"WITH {_LOGLIKS.format(by='theta_idx')} SELECT theta_idx, 0 AS iteration, 'pfilter' AS method, round(lme, 5) AS loglik, round(se, 5) AS se, theta_idx / 2.0::DOUBLE AS a FROM u")
def filter_traces(spark, sf):
    sets = theta.from_dicts(spark, [{"a": i / 2} for i in range(10)])
    return rounded(results.filter_traces(_loglik_rows(spark, sf), sets, ["a"]), 5)


_PANEL_LOGLIKS = _LOGLIKS.format(by="theta_idx, unit")


def _panel_sets(spark, sf):
    units = [r.unit for r in _loglik_rows(spark, sf).select("unit").distinct().orderBy("unit").collect()]  # five priorities
    shared = spark.createDataFrame([(i, "a", i / 2) for i in range(10)], "theta_idx int, parameter string, value double")
    unit = spark.createDataFrame([(i, u, "b", i + len(u) / 10) for i in range(10) for u in units], "theta_idx int, unit string, parameter string, value double")
    return shared, unit


@query(f"WITH {_PANEL_LOGLIKS} SELECT theta_idx, round(sum(lme) OVER p, 4) AS shared_loglik, round(sqrt(sum(se * se) OVER p), 4) AS shared_se, unit, round(lme, 4) AS unit_loglik, round(se, 4) AS unit_se, theta_idx / 2.0::DOUBLE AS a, round(theta_idx + length(unit) / 10.0, 4)::DOUBLE AS b FROM u WINDOW p AS (PARTITION BY theta_idx)")
def panel_filter_view(spark, sf):
    return rounded(results.panel_filter_view(_loglik_rows(spark, sf), *_panel_sets(spark, sf)), 4)


@query(f"WITH {_PANEL_LOGLIKS} SELECT theta_idx, unit, 0 AS iteration, 'pfilter' AS method, round(lme, 4) AS loglik, round(se, 4) AS se, theta_idx / 2.0::DOUBLE AS a, round(theta_idx + length(unit) / 10.0, 4)::DOUBLE AS b FROM u UNION ALL SELECT theta_idx, 'shared', 0, 'pfilter', round(sum(lme), 4), round(sqrt(sum(se * se)), 4), theta_idx / 2.0, NULL FROM u GROUP BY theta_idx")
def panel_filter_traces(spark, sf):
    return rounded(results.panel_filter_traces(_loglik_rows(spark, sf), *_panel_sets(spark, sf)), 4)
