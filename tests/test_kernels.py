import math

import numpy as np
import pytest

from murmur.functions import optimizers, proposals, special
from murmur.functions.transforms import Transform
from murmur.operators import kernels as K
from murmur.operators import models
from murmur.operators.profiles import arma_loglik, loess, mcap, negbin_loglik

TRUE = {"A11": 0.8, "C11": 1.0, "Q11": 0.5, "R11": 0.3, "X0_1": 0.0}


@pytest.fixture(scope="module")
def lg():
    model = models.linear_gaussian().tried(TRUE)
    t = 100
    s = K.Series(0.0, np.arange(1, t + 1.0), np.ones(t, int), np.ones(t), {"Y1": np.zeros(t)}, {})
    _, observed = K.simulate(model, TRUE, s, 1, np.random.default_rng(5))
    s.y = {"Y1": np.array([o["Y1"][0] for o in observed])}
    return model, s


def exact(s, a, q, r):
    return K.kalman_loglik(s.y["Y1"], a, 1.0, q * q, r * r, 0.0, q * q)


def test_filter_agrees_with_the_exact_likelihood(lg):
    model, s = lg
    logliks = [K.pfilter(model, TRUE, s, 3000, np.random.default_rng(i))["loglik"] for i in range(10)]
    assert abs(K._log_mean(logliks) - exact(s, 0.8, 0.5, 0.3)) < 0.225


def test_filter_with_missing_weights_and_threshold(lg):
    model, s = lg
    out = K.pfilter(model, TRUE, s, 500, np.random.default_rng(1), thresh=100.0)
    assert abs(out["loglik"] - exact(s, 0.8, 0.5, 0.3)) < 8 and min(out["ess"]) > 0
    far = K.Series(s.t0, s.times, s.nstep, s.dt, {"Y1": s.y["Y1"] + 1e200}, {})
    assert K.pfilter(model, TRUE, far, 50, np.random.default_rng(1))["loglik"] == -np.inf


def test_gradient_matches_the_exact_one(lg):
    model, s = lg
    at = np.array([0.8, math.log(0.5), math.log(0.3)])
    f = lambda x: -exact(s, x[0], math.exp(x[1]), math.exp(x[2])) / 100
    expected = np.array([(f(at + 1e-5 * e) - f(at - 1e-5 * e)) / 2e-5 for e in np.eye(3)])
    got = np.mean([K.gradient(model, ["A11", "Q11", "R11"], at, model.transform.to_est(TRUE), s, 2000, 0.97, i)[1] for i in range(4)], axis=0)
    assert np.allclose(got, expected, atol=0.1)


def test_iterated_filtering_improves(lg):
    model, s = lg
    start = TRUE | {"A11": 0.4, "Q11": 0.9, "R11": 0.8}
    rows = K.mif(model, start, s, 500, 40, K.Perturbation({"A11": 0.02, "Q11": 0.02, "R11": 0.02}), np.random.default_rng(2), monitors=1)
    assert len(rows) == 41 and np.isnan(rows[0]["loglik"])
    end = rows[-1]
    assert exact(s, end["A11"], end["Q11"], end["R11"]) > exact(s, 0.4, 0.9, 0.8) + 10


@pytest.mark.parametrize("name", sorted(optimizers.OPTIMIZERS))
def test_every_optimizer_takes_steps(lg, name):
    model, s = lg
    names = ["A11", "Q11", "R11"]
    rates = optimizers.learning_rates({n: 0.02 for n in names}, names, 3)
    rows = K.train(model, TRUE | {"A11": 0.5}, {"s": s}, 100, 3, rates, names, np.random.default_rng(0), optimizer=name)
    assert len(rows) == 4 and rows[-1]["A11"] != 0.5 and rows[-1]["C11"] == 1.0


def test_panel_filters_keep_shared_parameters_shared(lg):
    model, s = lg
    own = {u: {k: TRUE[k] for k in ("Q11", "R11", "X0_1")} for u in ("a", "b")}
    for block in (True, False):
        rows = K.panel_mif(model, {"A11": 0.5, "C11": 1.0}, own, {"a": s, "b": s}, 100, 2, K.Perturbation({"A11": 0.02, "Q11": 0.02}), np.random.default_rng(0), block=block)
        assert [r["unit"] for r in rows] == ["shared", "a", "b"] * 3
        assert rows[3]["loglik"] == pytest.approx(rows[4]["loglik"] + rows[5]["loglik"])


def test_chains(lg):
    model, s = lg
    rows = K.pmcmc(model, TRUE, s, 50, 20, proposals.AdaptiveWalk({"A11": 0.02}), np.random.default_rng(0))
    assert len(rows) == 21 and all(r["Q11"] == 0.5 or abs(r["Q11"] - 0.5) < 1e-12 for r in rows)
    probe = {"sd": lambda y: float(np.std(y["Y1"]))}
    rows = K.abc(model, TRUE, s, 20, proposals.DiagonalWalk({"A11": 0.02}), probe, {"sd": 0.1}, 3.0, np.random.default_rng(0))
    assert all(r["distance"] < 9 for r in rows[1:] if r["accepted"])
    with pytest.raises(ValueError):
        K.abc(model, TRUE, s, 1, proposals.DiagonalWalk({}), probe, {"sd": 0.0}, 1.0, np.random.default_rng(0))


def test_special_functions_against_the_standard_library():
    for x in (1e-3, 0.5, 1, 2.5, 7.9, 8, 100, 1e6):
        assert special.lgamma(x) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    for x in (-5.0, 0.0, 3.0):
        assert special.log_ndtr(x) == pytest.approx(math.log(0.5 * math.erfc(-x / math.sqrt(2))), rel=1e-12)
    assert special.log_ndtr(-40.0) == pytest.approx(-804.608442, rel=1e-8)
    assert special.log_diff_ndtr(10.0, 11.0) == pytest.approx(-53.2313103, rel=1e-7)


def test_lgamma_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in (0.1, 1.0, 7.5, 8.0, 300.0)], "x double").select("x", special.lgamma_column(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in rows)


def test_transforms_come_back():
    t = Transform(log=("a",), logit=("b",), simplex=(("p", "q"),))
    theta = {"a": 2.0, "b": 0.3, "p": 0.25, "q": 0.75, "c": -1.0}
    back = t.from_est(t.to_est(theta))
    assert all(float(back[k]) == pytest.approx(theta[k]) for k in theta)
    h = 1e-6
    plain = Transform(log=("a",), logit=("b",))
    est = plain.to_est({"a": 2.0, "b": 0.3})
    numeric = sum(math.log((float(plain.from_est(est | {k: est[k] + h})[k]) - float(plain.from_est(est | {k: est[k] - h})[k])) / (2 * h)) for k in est)
    assert plain.log_jacobian(est) == pytest.approx(numeric, abs=1e-6)


def test_profile_interval_covers_a_parabola():
    x = np.linspace(0.1, 0.5, 20)
    out = mcap(x, -400 * (x - 0.3) ** 2)
    assert out["mle"] == pytest.approx(0.3, abs=0.01) and out["lo"] < 0.3 < out["hi"]
    assert out["hi"] - 0.3 == pytest.approx(math.sqrt(1.9207 / 400), abs=0.01)
    assert np.allclose(loess(np.ones(5), np.arange(5.0), np.ones(2)), 2.0)


def test_benchmarks_are_near_simple_likelihoods():
    y = np.random.default_rng(42).poisson(10, 200).astype(float)
    poisson = sum(v * math.log(y.mean()) - y.mean() - math.lgamma(v + 1) for v in y)
    assert negbin_loglik(y) >= poisson - 0.5
    normal = -0.5 * len(y) * (math.log(2 * math.pi * y.var()) + 1)
    assert arma_loglik(y, 0, 0, 0) == pytest.approx(normal, abs=1e-2)
    assert arma_loglik(y, 1, 0, 1) >= normal - 0.1


MEASLES = dict(R0=50.0, sigma=28.0, gamma=30.0, iota=1.0, iota1=0.5, iota2=0.3, rho=0.5, sigmaSE=0.05, psi=0.1, cohort=0.1, amplitude=0.2, alpha=0.9, mu=0.05, S_0=0.05, E_0=0.0005, I_0=0.0005, R_0=0.95)


@pytest.mark.parametrize("variant", models.MEASLES)
def test_measles_variants_filter_and_skip_missing_cases(variant):
    model = models.measles(variant)
    theta = {k: MEASLES[k] for k in model.parameters}
    model.tried(theta)
    covars = {"pop": np.full(43, 1e5), "birthrate": np.full(43, 2000.0), "std_log_pop_1950": np.full(43, 0.4)}
    s = K.Series(1950.0, 1950 + np.arange(1, 4) / 26, np.full(3, 14), np.full(3, 1 / 365.25), {"cases": np.array([30.0, np.nan, 20.0])}, {c: covars[c] for c in model.covariates})
    out = K.pfilter(model, theta, s, 100, np.random.default_rng(0))
    assert np.isfinite(out["loglik"]) and out["cll"][1] == pytest.approx(0)
    _, seen = K.simulate(model, theta, s, 5, np.random.default_rng(1))
    assert all((o["cases"] >= 0).all() for o in seen)
    assert all(float(v) == pytest.approx(theta[k]) for k, v in model.transform.from_est(model.transform.to_est(theta)).items() if not k.endswith("_0"))


def test_measles_variants_differ_where_they_should():
    from murmur.functions.rng import Expected

    x = {k: np.array([v]) for k, v in dict(S=4000.0, E=50.0, I=40.0, R=0.0, W=0.0, C=3.0, logw=0.0).items()}
    covars = {"pop": 1e5, "birthrate": 2000.0, "std_log_pop_1950": 0.4}
    after = {v: models.measles(v).rproc(x, MEASLES, covars, 1950.3, 1 / 365.25, Expected()) for v in models.MEASLES}
    exposed = {v: float(after[v]["E"][0]) for v in after}
    assert exposed["001b"] == pytest.approx(exposed["001d"]) and exposed["002"] == pytest.approx(exposed["002d"])
    assert len({round(exposed[v], 6) for v in ("001", "001b", "002", "003")}) == 4
    assert float(after["003"]["C"][0]) > float(after["001b"]["C"][0]) + 0.1  # 003 counts infections, the others removals
    assert set(after["001d"]) - set(after["001b"]) == {"logw"} and float(after["001d"]["logw"][0]) < 0
    with pytest.raises(ValueError):
        models.measles("004")


def test_log_weights_are_the_draws_own_density():
    model = models.measles("001d")
    x = {k: np.array([float(v)]) for k, v in dict(S=30, E=5, I=4, R=0, W=0, C=0, logw=0).items()}
    covars = {"pop": 1e3, "birthrate": 20.0}

    class Fixed:
        """A gamma of mean noise, three births, then two, one and no exits of each state by either rate."""

        def __init__(self):
            self.exits = iter([2.0, 1.0, 1.0, 0.0, 0.0, 1.0])

        def standard_gamma(self, shape):
            return np.asarray(shape, float)

        def poisson(self, lam):
            return np.full(np.shape(lam), 3)

        def binomial(self, n, p):
            return np.full(np.shape(n), int(next(self.exits)))

    dt = 1 / 52
    out = model.rproc(x, MEASLES, covars, 1950.33, dt, Fixed())
    mu, season = 0.02, 1 + MEASLES["amplitude"] * 0.2411 / 0.7589
    force = MEASLES["R0"] * season * (1 - math.exp(-(30.0 + mu) * dt)) / dt * (4 + MEASLES["iota"]) / 1e3
    lam = 0.9 * 20 * dt
    total = 3 * math.log(lam) - lam - math.lgamma(4)
    for n, (a, b), rate in ((30, (2, 1), force), (5, (1, 0), 28.0), (4, (0, 1), 30.0)):
        gone = 1 - math.exp(-(rate + mu) * dt)
        p = [gone * rate / (rate + mu), gone * mu / (rate + mu), 1 - gone]
        total += math.lgamma(n + 1) + sum(k * math.log(q) - math.lgamma(k + 1) for k, q in zip((a, b, n - a - b), p))
    assert float(out["logw"][0]) == pytest.approx(total, rel=1e-9)


def test_cholera_clips_counts_and_floors():
    from murmur.functions.rng import Expected

    theta = dict(gamma=20.8, m=0.06, rho=0.0, epsilon=19.1, c=1.0, beta_trend=-0.00498, sigma=3.13, tau=0.23, alpha=0.5, delta=0.02, S_0=0.6, I_0=0.4, Y_0=0.0, R1_0=0.0, R2_0=0.0, R3_0=0.0) | {f"bs{i}": 0.1 for i in range(1, 7)} | {f"omegas{i}": -3.0 for i in range(1, 7)}
    covars = {"trend": 0.1, "dpopdt": 0.0, "pop": 100.0} | {f"seas{i}": 1 / 6 for i in range(1, 7)}
    x = {k: np.array([v, v]) for k, v in dict(S=60.0, I=20.0, Y=0.0, R1=1.0, R2=1.0, R3=1.0, Mn=0.5, count=0.0).items()}
    for noise in ("normal", "gamma"):
        model = models.cholera(noise)
        out = model.rproc(x, theta, covars, 0.0, 1 / 240, Expected())
        force = math.exp(-3.0) + math.exp(-0.00498 * 0.1 + 0.1) * (20 / 100) ** 0.5  # the exponent counts
        assert out["S"][0] == pytest.approx(60 + (0.02 * 100 - force * 60 - 0.02 * 60 + 3 * 19.1) / 240)
        gone = model.rproc(x | {"S": np.array([0.0, 60.0]), "R3": np.zeros(2), "Mn": np.array([0.5, -9.0])}, theta, covars | {"dpopdt": -500.0}, 0.0, 1 / 240, Expected())
        assert gone["S"][0] == 0 and gone["count"].tolist() == [1.0, 1.0] and gone["Mn"][1] == 0  # also negative deaths are counted
        density = model.dmeas({"deaths": 0.6}, gone | {"count": np.array([0.0, 1.0])}, theta, covars, 0.0)
        assert density[1] == pytest.approx(math.log(1e-18)) and density[0] > -10
    with pytest.raises(ValueError):
        models.cholera("pink")


def test_profile_interval_of_the_published_example():
    x = np.linspace(0.1, 0.5, 10)
    y = -0.5 * (x - 0.3) ** 2 + np.array([0.01, -0.02, 0.03, -0.01, 0.02, -0.03, 0.01, -0.02, 0.03, -0.01])
    out = mcap(x, y)
    assert abs(out["mle"] - 0.23293293) < 0.05 and abs(out["quadratic_max"] - 0.23196971) < 0.05 and out["lo"] == pytest.approx(0.1, abs=1e-5) and out["hi"] == pytest.approx(0.5, abs=1e-5)
    assert abs(out["delta"] - 1.93755414) < 0.1 and abs(out["se_stat"] - 0.35499986) < 0.1 and abs(out["se_mc"] - 0.03322532) < 0.05 and abs(out["se_total"] - 0.35655129) < 0.1


def test_loess_casts_outliers_out():
    x = np.linspace(0, 1, 40)
    y = 2 * x + 0.01 * np.sin(50 * x)
    y[20] += 30
    at = np.array([x[20]])
    assert abs(loess(x, y, at)[0] - 2 * x[20]) < 0.05 < abs(loess(x, y, at, robust=0)[0] - 2 * x[20])


def test_curvature_pairs_are_of_the_steps_taken():
    a = np.array([[3.0, 0.5], [0.5, 1.0]])
    opt, x = optimizers.BFGS(), np.array([1.0, -2.0])
    for i in range(60):
        x = opt.step(x, a @ x, None, i, np.array([0.5, 0.5]))
    assert np.allclose(x, 0, atol=1e-6) and np.allclose(opt.state["inverse"], np.linalg.inv(a), atol=0.05)


def test_monitors_filter_the_rows_of_training(lg):
    model, s = lg
    names = ["A11"]
    rows = K.train(model, TRUE, {"s": s}, 50, 2, optimizers.learning_rates({"A11": 0.01}, names, 2), names, np.random.default_rng(0), monitors=4)
    assert len(rows) == 3 and all(abs(r["loglik"] - exact(s, r["A11"], 0.5, 0.3)) < 8 for r in rows)


def test_panel_training_by_process_density():
    model = models.sir()
    theta = dict(gamma=26.0, mu=0.02, iota=0.01, beta1=400.0, beta2=480.0, beta3=320.0, beta_sd=0.01, pop=1e5, rho=0.1, k=0.1, S_0=0.065, I_0=0.001, R_0=0.934)
    s = K.Series(0.0, np.arange(1, 4) / 52, np.full(3, 5), np.full(3, 1 / 260), {"reports": np.array([5.0, 6.0, 9.0])}, {f"seas_{i}": np.full(16, 1 / 3) for i in (1, 2, 3)})
    names = ["rho", "k"]
    own = {"a": {"rho": 0.1}, "b": {"rho": 0.2}}
    rows = K.train(model, theta, {"a": s, "b": s}, 40, 2, optimizers.learning_rates({n: 0.05 for n in names}, names, 2), names, np.random.default_rng(0), dpop=True, specific=("rho",), units=own)
    last = {r["unit"]: r for r in rows[-2:]}
    assert len(rows) == 6 and last["a"]["rho"] != last["b"]["rho"] and last["a"]["k"] == last["b"]["k"] != 0.1 and np.isfinite(last["a"]["loglik"])


def test_full_and_adaptive_walks():
    g, zero = np.random.default_rng(3), {"a": 0.0, "b": 0.0, "c": 7.0}
    walk = proposals.FullWalk(names=("a", "b"), covariance=np.array([[1.0, 0.8], [0.8, 1.0]]))
    drawn = [walk.propose(zero, g) for _ in range(4000)]
    assert abs(np.corrcoef([[p["a"], p["b"]] for p in drawn], rowvar=False)[0, 1] - 0.8) < 0.05 and all(p["c"] == 7.0 for p in drawn)
    target = np.array([[1.0, 0.9], [0.9, 1.0]])  # a chain on a normal density: past its warm-up, its steps follow the density's shape
    density = lambda p: -0.5 * np.array([p["a"], p["b"]]) @ np.linalg.solve(target, np.array([p["a"], p["b"]]))
    walk, at, took = proposals.AdaptiveWalk({"a": 1.0, "b": 1.0}), {"a": 0.0, "b": 0.0}, 0
    for i in range(6000):
        trial = walk.propose(at, g)
        yes = np.log(g.random()) < density(trial) - density(at)
        at, took = (trial, took + 1) if yes else (at, took)
        walk.learn(at, bool(yes), i)
    steps = np.array([[(t := walk.propose(at, g))["a"] - at["a"], t["b"] - at["b"]] for _ in range(3000)])
    assert abs(np.corrcoef(steps, rowvar=False)[0, 1] - 0.9) < 0.1 and 0.1 < took / 6000 < 0.6


def test_models_report_mistakes_on_the_driver():
    with pytest.raises(KeyError):
        models.linear_gaussian().tried({})
    broken = models.linear_gaussian().with_functions(rproc=lambda x, *a: {"Z": x["X1"]})
    with pytest.raises(ValueError):
        broken.tried(TRUE)


def test_quantile_samplers():
    from murmur.functions import quantiles as Q

    u = (np.arange(4000) + 0.5) / 4000
    assert abs(Q.poisson(u, 7.0).mean() - 7) < 0.01 and abs(Q.poisson(u, 7.0).var() - 7) < 0.1
    assert abs(Q.binomial(u, 20, 0.3).mean() - 6) < 0.01 and abs(Q.gamma(u, 2.5).mean() - 2.5) < 0.02 and abs(Q.gamma(u, 0.2).mean() - 0.2) < 0.01
    assert Q.poisson(0.5, -1.0) == -1 and Q.poisson(0.5, 0.0) == 0 and Q.binomial(0.5, 5, 2.0) == -1 and np.isnan(Q.gamma(0.5, -1.0))
    assert (Q.binomial(u[:5], 9, 1.0) == 9).all() and (Q.binomial(u[:5], 9, 0.0) == 0).all()
    g = np.random.default_rng(0)
    counts = Q.multinomial(g.random((3000, 2)), 12, np.array([[1.0, 2.0, 3.0]]))
    assert (counts.sum(axis=1) == 12).all() and np.allclose(counts.mean(axis=0), [2, 4, 6], atol=0.15)
    assert abs(Q.negative_binomial(g.random(4000), g.random(4000), 3.0, mu=6.0).mean() - 6) < 0.3
    assert Q.normal(np.array([0.025, 0.5, 0.975])) == pytest.approx([-1.959964, 0, 1.959964], abs=1e-6)
    with pytest.raises(ValueError):
        Q.negative_binomial(0.5, 0.5, 1.0)


def test_quantile_samplers_settle_ties_as_sql(tmp_path, spark):
    import duckdb

    from murmur.functions import quantiles as Q
    from murmur.plans import replay_queries

    # Each uniform is a cumulated probability: 0.3025 = 0.55 ** 2, 0.9375 = 15 / 16.
    assert Q.binomial(np.array([0.3025, 0.9375, 0.9375]), np.array([2, 4, 7]), np.array([0.45, 0.5, 0.5])).tolist() == [0, 3, 6]
    assert Q.binomial(0.3025, 2, 0.45) == 0 and Q.poisson(1.0, 0.0) == 0 and Q.binomial(1.0, 3, 1.0) == 3
    c = duckdb.connect()
    c.sql(f"""COPY (SELECT row_number() OVER () AS l_orderkey, 1::INT AS l_linenumber, n::DOUBLE AS l_quantity, d / 100.0::DOUBLE AS l_discount, u AS l_partkey
      FROM range(2, 8) a(n), range(11) b(d), range(1000) e(u) WHERE u % 5 < 3) TO '{tmp_path}/lineitem.parquet'""")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    got = replay_queries.QUERIES["quantile_draws"](spark, str(tmp_path)).toPandas().sort_values("l_orderkey")
    expected = c.sql(replay_queries.ORACLES["quantile_draws"]).df().sort_values("l_orderkey")
    assert (got[["poisson", "binomial"]].to_numpy() == expected[["poisson", "binomial"]].to_numpy()).all()


def test_splines_interpolate_smooth_and_go_on_as_lines():
    from murmur.functions.splines import smoothing_spline

    x = np.linspace(0, 3, 13)
    assert np.allclose(smoothing_spline(x, np.sin(x), x), np.sin(x))
    line = smoothing_spline(x, 2 * x + 1, np.array([-5.0, 1.1, 9.0]), lam=3.0)
    assert np.allclose(line, [-9, 3.2, 19])
    flat = smoothing_spline(x, np.sin(x), x, lam=1e9)
    assert np.allclose(flat, np.polyval(np.polyfit(x, np.sin(x), 1), x), atol=1e-4)
