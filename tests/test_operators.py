import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions import rng, stats
from murmur.operators import grid, inference, kalman, resample, results, theta
from murmur.operators.kernels import Perturbation, systematic
from murmur.operators.models import linear_gaussian
from murmur.plans import particle_queries
from murmur.sources import series

START = particle_queries.START


@pytest.fixture(scope="module")
def packed(spark):
    y = np.random.default_rng(1).normal(0, 0.35, 30)
    rows = [("s", float(i + 1), float(v)) for i, v in enumerate(y)]
    model = linear_gaussian()
    return inference.packed(spark.createDataFrame(rows, "series_id string, time double, Y1 double"), model, 0.0, nstep=1), model, y


def test_filter_operator_is_near_exact_and_partition_invariant(spark, packed):
    data, model, y = packed
    sets = theta.from_dicts(spark, [START])
    run = lambda d: {(r.rep): r.loglik for r in inference.logliks(inference.pfilter(d, model, sets, particles=2000, reps=6)).collect()}
    first, second = run(data), run(data.repartition(7))
    assert first == second
    lg = spark.createDataFrame([(0, 0.8, 1.0, 0.09, 0.0625, 0.0, 0.09)], "theta_idx int, a double, c double, q double, r double, x0 double, p0 double")
    exact = kalman.run(spark.createDataFrame([("s", float(i), float(v)) for i, v in enumerate(y)], "series_id string, time double, y double"), lg).first().loglik
    assert abs(np.log(np.mean(np.exp(np.array(list(first.values())) - exact)))) < 0.3


def test_uneven_intervals_start_from_the_given_step(spark):
    rows = [("s", t) for t in (1.0, 1.0, 4.0)]
    out = grid.interval_steps(spark.createDataFrame(rows, "series_id string, time double"), 0.0, dt=0.5).orderBy("obs_idx").collect()
    assert [(r.nstep, r.dt) for r in out] == [(2, 0.5), (0, 0.0), (6, 0.5)]
    with pytest.raises(ValueError):
        grid.interval_steps(spark.createDataFrame(rows, "series_id string, time double"), 0.0)
    with pytest.raises(ValueError):
        grid.interpolate(spark.range(1), spark.range(1), [], order="cubic")


def test_interpolation_beyond_the_knots_and_with_one_knot(spark):
    knots = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.0, 3.0), ("one", 5.0, 7.0)], "series_id string, time double, v double")
    points = spark.createDataFrame([("s", t) for t in (-1.0, 0.0, 0.5, 1.0, 2.0)] + [("one", 0.0)], "series_id string, t double")
    linear = {(r.series_id, r.t): r.v for r in grid.interpolate(points, knots, ["v"]).collect()}
    assert linear == {("s", -1.0): -1.0, ("s", 0.0): 1.0, ("s", 0.5): 2.0, ("s", 1.0): 3.0, ("s", 2.0): 5.0, ("one", 0.0): 7.0}
    constant = {(r.series_id, r.t): r.v for r in grid.interpolate(points, knots, ["v"], order="constant").collect()}
    assert constant == {("s", -1.0): 1.0, ("s", 0.0): 1.0, ("s", 0.5): 1.0, ("s", 1.0): 3.0, ("s", 2.0): 3.0, ("one", 0.0): 7.0}


def test_resampling_equals_numpy(spark):
    g = np.random.default_rng(3)
    lw = g.normal(0, 3, 400)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(lw)], "g int, idx int, lw double")
    got = [r.idx for r in resample.systematic(df, ["g"], "idx", "lw", F.lit(0.37)).orderBy("slot").collect()]

    class Fixed:
        def random(self):
            return 0.37

    assert got == systematic(lw, Fixed()).tolist()


def test_logmeanexp_corner_cases(spark):
    nan, low = float("nan"), float("-inf")
    rows = [("all", v) for v in (100.0, 101.0, 102.0, 103.0, 104.0)] + [("low", low), ("low", low), ("one", 3.0), ("far", 0.0), ("far", -2000.0), ("nan", 1.0), ("nan", nan)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r.g: r for r in stats.logmeanexp(df, ["g"], "x").collect()}
    assert out["all"].lme == pytest.approx(102.8424765, abs=1e-6) and out["all"].se == pytest.approx(0.7510094, abs=1e-6)
    assert out["low"].lme == low and out["one"].lme == 3.0 and np.isnan(out["one"].se)
    assert out["far"].se == pytest.approx(1000.0)
    assert np.isnan(out["nan"].lme)
    assert {r.g: r.lme for r in stats.logmeanexp(df, ["g"], "x", ignore_nan=True).collect()}["nan"] == 1.0


def test_collapsed_weights_are_even(spark):
    df = spark.createDataFrame([(0, float("-inf"))] * 4, "g int, lw double")
    rows = stats.normalise_weights(df, ["g"], "lw").collect()
    assert all(r.log_sum == float("-inf") and r.norm_lw == pytest.approx(-np.log(4)) for r in rows)


def test_parameter_sets(spark):
    with pytest.raises(ValueError):
        theta.from_dicts(spark, [{"a": 1.0}, {"b": 1.0}])
    with pytest.raises(TypeError):
        theta.from_dicts(spark, [{"a": True}])
    sets = theta.from_dicts(spark, [{"a": float(i)} for i in range(4)], [1.0, float("nan"), 3.0, 3.0])
    best = [r.params["a"] for r in theta.prune(sets, 3).orderBy("theta_idx").collect()]
    assert best == [2.0, 3.0, 0.0]
    assert theta.prune(sets, 2, refill=True).count() == 4
    assert theta.same(sets, sets) and not theta.same(sets, sets.limit(2))
    drawn = theta.sample(spark, {"a": (0.0, 1.0)}, 50, 3)
    assert theta.same(drawn.selectExpr("theta_idx", "params['a'] a"), theta.sample(spark, {"a": (0.0, 1.0)}, 50, 3).repartition(9).selectExpr("theta_idx", "params['a'] a"))


def test_hash_uniforms_are_uniform(spark):
    u = [r.u for r in spark.range(4000).select(rng.hash_uniform("id").alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02
    z = [r.z for r in spark.range(4000).select(rng.hash_normal("id").alias("z")).collect()]
    assert abs(np.std(z) - 1) < 0.05


def test_estimation_operators_return_traces(spark, packed):
    data, model, _ = packed
    sets = theta.from_dicts(spark, [START, START | {"A11": 0.5}])
    traces = inference.mif(data, model, sets, particles=50, iterations=3, perturbation=Perturbation({"A11": 0.02})).cache()
    assert traces.count() == 8 and results.last_iteration(traces, ("theta_idx",)).select("iteration").distinct().first().iteration == 3
    states, observed = inference.simulate(data, model, sets, sims=2)
    assert states.count() == 2 * 2 * 31 and observed.count() == 2 * 2 * 30
    assert inference.as_series(observed).count() == 30
    assert inference.check_panel(data.unionByName(data.withColumn("series_id", F.lit("t")))).count() == 0


def test_hashed_draws_are_uniform_and_repeat():
    first, second = rng.Hashed(1, "s", 0, 0), rng.Hashed(1, "s", 0, 0)
    u = first.random(50_000)
    assert (u == second.random(50_000)).all() and (u != first.random(50_000)).any() and (u > 0).all() and (u < 1).all()
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.02 and abs(np.std(first.standard_normal(50_000)) - 1) < 0.02
    assert abs(first.poisson(np.full(3000, 4.0)).mean() - 4) < 0.2 and abs(first.binomial(np.full(3000, 10), np.full(3000, 0.3)).mean() - 3) < 0.2 and abs(first.standard_gamma(np.full(3000, 2.0)).mean() - 2) < 0.15


def test_a_history_keeps_runs_and_ranks_parameters(spark, packed, tmp_path):
    data, model, _ = packed
    history = results.History(spark, f"file://{tmp_path}/history")
    sets = theta.from_dicts(spark, [START | {"A11": 0.1, "Q11": 2.0}, START])
    assert history.add("pfilter", "table", lambda: inference.pfilter(data, model, sets, particles=200, reps=3), seed=1, config={"J": 200}) == 0
    ranked = history.best(sets)
    assert [r.loglik is not None for r in ranked.collect()] == [True, True] and theta.prune(ranked, 1).first().params["A11"] == START["A11"]
    assert history.add("mif", "trace", lambda: inference.mif(data, model, sets, particles=50, iterations=2, perturbation=Perturbation({"A11": 0.02}))) == 1
    view = results.estimate_view(history.payload()).orderBy("theta_idx").collect()
    assert len(view) == 2 and view[0].se is None and view[0].C11 == 1.0
    traces = results.estimate_traces(history.payload(), "mif")
    assert traces.columns[:5] == ["theta_idx", "iteration", "method", "loglik", "se"] and traces.count() == 6
    told = results.summary(results.filter_results(inference.logliks(history.payload(0))), history.runs())
    assert "0: pfilter (table)" in told and "1: mif (trace)" in told and "Best 2 sets" in told
    assert [r.method for r in results.run_times(history.runs()).orderBy("history_index").collect()] == ["pfilter", "mif"]


def test_chains_without_a_number_go(spark):
    df = spark.createDataFrame([("s", 0, 0, 0, float("nan"), 1.0), ("s", 0, 0, 1, 2.0, 1.0)], "series_id string, theta_idx int, rep int, iteration int, loglik double, a double")
    assert results.chain_view(df, ignore_nan=True).count() == 1 and results.chain_traces(df, "pmcmc").columns[:4] == ["theta_idx", "iteration", "method", "loglik"]


def test_simulated_chunks_are_whole(spark, packed):
    data, model, _ = packed
    states, observed = inference.simulate(data, model, theta.from_dicts(spark, [START]), sims=250, chunk=100)
    assert observed.select("sim").distinct().count() == 250 and states.where("time = 0").count() == 250
    spread = observed.groupBy("time").agg(F.stddev_samp("Y1").alias("s")).agg(F.min("s")).first()[0]
    assert spread > 0.2


def test_many_points_meet_their_sets_without_a_broadcast(spark, packed, monkeypatch):
    data, model, _ = packed
    sets = theta.from_dicts(spark, [START])
    run = lambda: {r.rep: r.loglik for r in inference.logliks(inference.pfilter(data, model, sets, particles=50, reps=3)).collect()}
    small = run()
    monkeypatch.setattr(inference, "BROADCAST_POINTS", 0)
    assert run() == small


def test_runs_merge(spark):
    a, b = (results.run_row(spark, 1, "pfilter", "table", seconds=s, config={"J": 10}) for s in (1.0, 3.0))
    merged = results.merged_runs(a, b).first()
    assert merged.seconds == 3.0 and merged.configs == 1
    assert results.run_times(a).first().method == "pfilter"


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", 1.0, 2.0)], "series_id string, time double, y double")
    series.write_table(df, f"{tmp_path}/t")
    assert theta.same(spark.read.parquet(f"{tmp_path}/t"), df)
    (tmp_path / "x.csv").write_text("time,y\n1,2.5\n")
    assert series.read_csv(spark, f"file://{tmp_path}/x.csv", "time double, y double").first().y == 2.5


def test_models_come_back_from_disk(spark, tmp_path):
    from murmur.sources import model_store

    sets = theta.from_dicts(spark, [START])
    model_store.save(f"file://{tmp_path}/m", "linear_gaussian", {"dx": 1, "dy": 1}, {"theta": sets})
    model, tables = model_store.load(spark, f"file://{tmp_path}/m")
    assert model.parameters == linear_gaussian().parameters and theta.same(tables["theta"], sets)
    with pytest.raises(KeyError):
        model_store.save(f"file://{tmp_path}/m", "unknown", {}, {"theta": sets})


@pytest.mark.parametrize("name", sorted(particle_queries.QUERIES))
def test_particle_queries_have_rows(spark, name):
    if name == "pfilter_yardstick":
        pytest.skip("bench only")
    assert particle_queries.QUERIES[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_every_customer_is_in_the_profile(spark):
    sf = "/root/testdata/sf0.01"
    customers, points = spark.read.parquet(f"{sf}/customer.parquet"), particle_queries._profile_points(spark, sf).toPandas()
    assert points.n.sum() == customers.count() > 200 and len(points) <= 500
    x = F.col("c_custkey") / customers.agg(F.max("c_custkey")).first()[0]
    total = customers.agg(F.sum(-20 * (x - 0.4) * (x - 0.4) + F.col("c_acctbal") / 1e6)).first()[0]
    assert (points.loglik * points.n).sum() == pytest.approx(float(total))
    assert points.parameter.max() > 0.99
    fit = particle_queries.profile_interval(spark, sf).first()
    assert fit.lo < 0.4 < fit.hi


def test_the_algorithms_see_whole_series(spark):
    sf = "/root/testdata/sf0.01"
    daily, panel = series.daily_orders(spark, sf), series.monthly_by_nation(spark, sf)
    got = particle_queries._daily(spark, sf)[0].select(F.size("obs").alias("n")).collect()
    assert [r.n for r in got] == [daily.count()]
    units = {r.series_id: r["count"] for r in panel.groupBy("series_id").count().collect()}
    assert {r.series_id: r.n for r in particle_queries._panel(spark, sf)[0].select("series_id", F.size("obs").alias("n")).collect()} == units
