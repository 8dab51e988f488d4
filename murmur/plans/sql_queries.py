"""Queries with a SQL oracle: each function and its DuckDB text stand side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import schedules, stats
from murmur.functions.rng import hash_normal, hash_uniform
from murmur.operators import grid, kalman, profiles, resample, results, theta
from murmur.operators.models import euler_exit_probabilities
from murmur.sources import series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

S1 = """s1 AS (
  SELECT datediff('day', DATE '1992-01-01', day)::DOUBLE AS time, v - avg(v) OVER () AS y
  FROM (SELECT o_orderdate::DATE AS day, ln(sum(o_totalprice)) AS v FROM orders GROUP BY 1))"""
S2 = """s2 AS (
  SELECT n_name AS series_id, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::DOUBLE AS time, ln(sum(o_totalprice)) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
PARTICLES = """p AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS idx, -l_discount * 30 - l_tax * 7 AS lw, l_quantity AS x FROM lineitem)"""
HASH = "((('0x' || substr(md5({0}), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"
LG = {"a": 0.8, "c": 1.0, "q": 0.09, "r": 0.05, "x0": 0.0, "p0": 0.09}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = series.read_table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), (-F.col("l_discount") * 30 - F.col("l_tax") * 7).alias("lw"), F.col("l_quantity").alias("x"))


@query(f"WITH {S1} SELECT round(time, 6) AS time, round(y, 6) AS y FROM s1")
def series_daily_orders(spark, sf):
    return rounded(series.daily_orders(spark, sf).select("time", "y"))


@query(f"WITH {S2} SELECT series_id, time, round(y, 6) AS y FROM s2")
def series_monthly_by_nation(spark, sf):
    return rounded(series.monthly_by_nation(spark, sf))


@query("SELECT event_type AS series_id, floor(epoch(date_trunc('hour', ts)) / 3600)::DOUBLE AS time, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def series_hourly_events(spark, sf):
    return rounded(series.hourly_events(spark, sf))


@query("SELECT ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1)::DOUBLE AS time, round(ln(sum(l_quantity)), 6) AS y, count(*) AS n FROM lineitem GROUP BY 1")
def series_monthly_shipments(spark, sf):
    return rounded(series.monthly_shipments(spark, sf).drop("series_id"))


@query(f"WITH {S2} SELECT series_id, time, CASE WHEN series_id = 'NATION_3' AND time = 40 THEN NULL ELSE round(y, 6) END AS y FROM s2 WHERE series_id IN ('NATION_3', 'NATION_6')")
def unit_subset(spark, sf):
    return rounded(series.unit_subset(series.monthly_by_nation(spark, sf), ["NATION_3", "NATION_6"], [("NATION_3", 40.0)]))


@query("SELECT o_orderkey, round(datediff('day', DATE '1994-01-01', o_orderdate::DATE) / 365.25 + 1994, 6) AS time FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995 AND o_orderdate::DATE > DATE '1994-01-01' AND datediff('day', DATE '1994-01-01', o_orderdate::DATE) / 365.25 + 1994 < 1996")
def year_window(spark, sf):
    orders = series.read_table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return rounded(series.year_window(orders, 1994, 1995).select("o_orderkey", "time"))


@query(f"WITH {S1}, r AS (SELECT time, ln(exp(y) / lag(exp(y)) OVER (ORDER BY time)) AS y FROM s1) SELECT time, round(y, 6) AS y FROM r WHERE y IS NOT NULL")
def log_returns(spark, sf):
    prices = series.daily_orders(spark, sf).withColumn("close", F.exp("y"))
    return rounded(series.log_returns(prices).select("time", "y"))


@query(f"WITH {S1} SELECT min(time) - 1 AS time, 0.0 AS y_prev FROM s1 UNION ALL SELECT time, round(y, 6) FROM s1")
def lagged_covariate(spark, sf):
    return rounded(series.lagged_covariate(series.daily_orders(spark, sf)).select("time", "y_prev"))


@query(f"WITH {S2}, n AS (SELECT series_id, time, row_number() OVER (PARTITION BY series_id ORDER BY time) AS i FROM s2) SELECT series_id, 2 * max(time) FILTER (i = 1) - max(time) FILTER (i = 2) AS t0 FROM n GROUP BY 1")
def start_time(spark, sf):
    return series.start_time(series.monthly_by_nation(spark, sf))


@query("WITH u AS (SELECT n_name AS unit, ln(count(*)) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT unit, round((x - avg(x) OVER ()) / (CASE WHEN stddev_samp(x) OVER () > 0 THEN stddev_samp(x) OVER () ELSE 1 END), 6) AS z FROM u")
def std_log_pop(spark, sf):
    customers = series.read_table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("pop"))
    units = customers.join(series.read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("unit"), "pop")
    return rounded(series.standardised(units, "pop"))


@query("SELECT o_orderkey % 100 AS k, variable, round(sum(value), 4) AS value FROM (UNPIVOT (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME variable VALUE value) GROUP BY 1, 2")
def wide_to_long(spark, sf):
    wide = series.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return series.wide_to_long(wide, "o_orderkey", "variable", "value").groupBy((F.col("o_orderkey") % 100).alias("k"), "variable").agg(F.round(F.sum("value"), 4).alias("value"))


@query("WITH a AS (SELECT n_name AS unit, year(o_orderdate) AS year, count(*) AS pop FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT n_name AS unit, year(o_orderdate) AS year, count(*) AS births FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT unit, year, pop, births FROM a FULL JOIN b USING (unit, year)")
def demography(spark, sf):
    orders = series.read_table(spark, sf, "orders").join(series.read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(series.read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = lambda status: orders.where(F.col("o_orderstatus") == status).groupBy(F.col("n_name").alias("unit"), F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count("*").alias("value"))
    return series.demography(counts("F"), counts("O"))


GRID = f"""{S1}, i AS (SELECT row_number() OVER (ORDER BY time) - 1 AS obs_idx, coalesce(lag(time) OVER (ORDER BY time), -1.0) AS t_from, time AS t_to FROM s1),
g AS (SELECT obs_idx, t_from, t_to, CASE WHEN t_from >= t_to THEN 0 WHEN t_from + 0.3 >= t_to THEN 1 ELSE ceil((t_to - t_from) / 0.3 / (1 + 1.4901161193847656e-08))::BIGINT END AS nstep FROM i)"""


@query(f"WITH {GRID} SELECT obs_idx, t_from, t_to, nstep, round((t_to - t_from) / nstep, 6) AS dt FROM g")
def grid_steps(spark, sf):
    return rounded(grid.interval_steps(series.daily_orders(spark, sf), -1.0, dt=0.3).drop("series_id").withColumns({c: F.col(c).cast("bigint") for c in ("obs_idx", "nstep")}))


@query(f"WITH {GRID}, e AS (SELECT obs_idx, unnest(range(nstep)) AS step_idx, t_from, (t_to - t_from) / nstep AS dt FROM g) SELECT obs_idx, step_idx, round(t_from + step_idx * dt, 6) AS t, round(dt, 6) AS dt FROM e UNION ALL SELECT max(obs_idx) + 1, 0, max(t_to), 0.0 FROM g")
def grid_explode(spark, sf):
    return rounded(grid.full_grid(series.daily_orders(spark, sf), -1.0, dt=0.3).drop("series_id").withColumns({c: F.col(c).cast("bigint") for c in ("obs_idx", "step_idx")}))


KNOTS = "k AS (SELECT ((year(o_orderdate) - 1992) * 365 + 40)::DOUBLE AS time, ln(count(*)) AS v FROM orders GROUP BY 1)"
POINTS = "pts AS (SELECT unnest(range(0, 2800, 7))::DOUBLE AS t)"


def _knots(spark, sf):
    return series.read_table(spark, sf, "orders").groupBy(F.lit("s").alias("series_id"), ((F.year("o_orderdate") - 1992) * 365 + 40).cast("double").alias("time")).agg(F.log(F.count("*")).alias("v"))


def _points(spark):
    return spark.range(0, 2800, 7).select(F.lit("s").alias("series_id"), F.col("id").cast("double").alias("t"))


@query(f"""WITH {KNOTS}, {POINTS}, seg AS (SELECT time AS a, v AS va, lead(time) OVER w AS b, lead(v) OVER w AS vb, row_number() OVER w AS i, count(*) OVER () AS n FROM k WINDOW w AS (ORDER BY time))
SELECT t, round(va + (vb - va) * (t - a) / (b - a), 6) AS v FROM pts JOIN seg ON b IS NOT NULL AND (t > a OR i = 1) AND (t <= b OR i = n - 1)""")
def covar_linear(spark, sf):
    return rounded(grid.interpolate(_points(spark), _knots(spark, sf), ["v"]).drop("series_id"))


@query(f"WITH {KNOTS}, {POINTS} SELECT t, round(coalesce(v, (SELECT min_by(v, time) FROM k)), 6) AS v FROM pts ASOF LEFT JOIN k ON t >= time")
def covar_constant(spark, sf):
    return rounded(grid.interpolate(_points(spark), _knots(spark, sf), ["v"], order="constant").drop("series_id"))


def _kalman_sql(tail: str) -> str:
    p = LG
    return f"""WITH RECURSIVE {S1}, o AS (SELECT row_number() OVER (ORDER BY time) AS i, time, y FROM s1),
k(i, time, m, v, ll, cll, pred) AS (
  SELECT 0::BIGINT, 0.0::DOUBLE, {p['x0']}::DOUBLE, {p['p0']}::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT o.i, o.time, {p['a']} * m + g * (y - {p['c']} * {p['a']} * m), (1 - g * {p['c']}) * pv, ll + c, c, {p['a']} * m
  FROM (SELECT *, {p['a'] ** 2} * v + {p['q']} AS pv FROM k) k2 JOIN o ON o.i = k2.i + 1,
    LATERAL (SELECT {p['c'] ** 2} * pv + {p['r']} AS s, {p['c']} * pv / ({p['c'] ** 2} * pv + {p['r']}) AS g),
    LATERAL (SELECT -0.5 * (ln(2 * pi()) + ln(s) + (y - {p['c']} * {p['a']} * m) ** 2 / s) AS c)
) {tail}"""


def _lg_theta(spark):
    return spark.createDataFrame([(0, *[LG[k] for k in kalman.PARAMETERS])], "theta_idx int, " + ", ".join(f"{k} double" for k in kalman.PARAMETERS))


@query(_kalman_sql("SELECT count(*) - 1 AS n, round(max_by(ll, i), 4) AS loglik FROM k"))
def kalman_loglik(spark, sf):
    daily = series.daily_orders(spark, sf)
    return kalman.run(daily, _lg_theta(spark)).select(daily.agg(F.count("*").alias("n")).scalar().alias("n"), F.round("loglik", 4).alias("loglik"))


@query(_kalman_sql("SELECT time, round(cll, 5) AS cll, round(m, 5) AS filter_mean, round(pred, 5) AS prediction_mean FROM k WHERE i > 0"))
def kalman_filter_means(spark, sf):
    out = kalman.steps(kalman.run(series.daily_orders(spark, sf), _lg_theta(spark), history=True))
    return rounded(out.select("time", "cll", "filter_mean", "prediction_mean"), 5)


@query(f"WITH {PARTICLES}, m AS (SELECT g, lw, max(lw) OVER (PARTITION BY g) AS mx FROM p) SELECT g, round(any_value(mx) + ln(avg(exp(lw - mx))), 6) AS lme FROM m GROUP BY g")
def logmeanexp_by_theta(spark, sf):
    return rounded(stats.logmeanexp(particles(spark, sf), ["g"], "lw").select("g", "lme"))


@query(f"WITH {PARTICLES}, m AS (SELECT g, lw, max(lw) OVER (PARTITION BY g) AS mx, count(*) OVER (PARTITION BY g) AS n FROM p), s AS (SELECT *, sum(exp(lw - mx)) OVER (PARTITION BY g) AS t FROM m), j AS (SELECT g, n, ln((t - exp(lw - mx)) / (n - 1)) AS j FROM s WHERE n > 1) SELECT g, round(sqrt(any_value(n) - 1) * stddev_pop(j), 6) AS se FROM j GROUP BY g")
def logmeanexp_se(spark, sf):
    return rounded(stats.logmeanexp(particles(spark, sf), ["g"], "lw").where("n > 1").select("g", "se"))


NORM = f"{PARTICLES}, m AS (SELECT *, max(lw) OVER (PARTITION BY g) AS mx FROM p), nw AS (SELECT g, idx, x, lw - mx - ln(sum(exp(lw - mx)) OVER (PARTITION BY g)) AS nlw, mx + ln(sum(exp(lw - mx)) OVER (PARTITION BY g)) AS ls FROM m)"


@query(f"WITH {NORM} SELECT g, idx, round(nlw, 6) AS norm_lw, round(ls, 6) AS log_sum FROM nw")
def normalize_weights(spark, sf):
    return rounded(stats.normalise_weights(particles(spark, sf), ["g"], "lw").select("g", "idx", "norm_lw", "log_sum"))


@query(f"WITH {NORM} SELECT g, round(1 / sum(exp(2 * nlw)), 5) AS ess FROM nw GROUP BY g")
def ess_by_group(spark, sf):
    return rounded(stats.ess(stats.normalise_weights(particles(spark, sf), ["g"], "lw"), ["g"]), 5)


@query(f"WITH {NORM} SELECT g, round(sum(exp(nlw) * x), 5) AS x FROM nw GROUP BY g")
def filter_mean(spark, sf):
    return rounded(stats.weighted_means(stats.normalise_weights(particles(spark, sf), ["g"], "lw"), ["g"], ["x"]), 5)


@query(f"""WITH {PARTICLES}, m AS (SELECT g, idx, exp(lw - max(lw) OVER (PARTITION BY g)) AS w FROM p),
c AS (SELECT g, idx, sum(w) OVER (PARTITION BY g ORDER BY idx) AS c, sum(w) OVER (PARTITION BY g) AS t, count(*) OVER (PARTITION BY g) AS j, {HASH.format("'u|' || g")} AS u FROM m),
n AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY g ORDER BY idx) AS b FROM c), pts AS (SELECT g, t, j, u, unnest(range(j)) AS slot FROM (SELECT DISTINCT g, any_value(t) AS t, any_value(j) AS j, any_value(u) AS u FROM n GROUP BY g))
SELECT g, slot, idx FROM pts JOIN n USING (g) WHERE (pts.u + slot) / pts.j >= b / n.t AND (pts.u + slot) / pts.j < n.c / n.t""")
def systematic_resample(spark, sf):
    return resample.systematic(particles(spark, sf), ["g"], "idx", "lw", hash_uniform(F.lit("u"), "g"))


def _theta(spark, sf):
    return series.read_table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("theta_idx"), F.col("c_acctbal").alias("loglik"), F.create_map(F.lit("k"), F.col("c_custkey").cast("double")).alias("params"))


def _flat(df):
    return df.select(F.col("theta_idx").cast("bigint").alias("theta_idx"), "loglik", F.col("params")["k"].alias("k"))


RANKED = "r AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS theta_idx, c_acctbal AS loglik, c_custkey::DOUBLE AS k FROM customer)"


@query(f"WITH {RANKED} SELECT theta_idx, loglik, k FROM r WHERE theta_idx < 10")
def prune_topn(spark, sf):
    return _flat(theta.prune(_theta(spark, sf), 10))


@query(f"WITH {RANKED}, n AS (SELECT count(*) AS n FROM customer) SELECT s AS theta_idx, loglik, k FROM n, LATERAL (SELECT unnest(range(n)) AS s), r WHERE r.theta_idx = s % 10")
def prune_refill(spark, sf):
    return _flat(theta.prune(_theta(spark, sf), 10, refill=True))


@query("SELECT CASE c_custkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS theta_idx, c_acctbal AS loglik, c_custkey::DOUBLE AS k FROM customer WHERE c_custkey IN (7, 3, 11)")
def theta_subset(spark, sf):
    return _flat(theta.subset(_theta(spark, sf), [7, 3, 11]))


@query(f"WITH {RANKED} SELECT theta_idx + 5 * i AS theta_idx, loglik, k FROM r, (SELECT unnest(range(3)) AS i) WHERE theta_idx < 5 UNION ALL SELECT theta_idx + 15, loglik, k FROM r WHERE theta_idx < 2")
def theta_merge(spark, sf):
    best = theta.prune(_theta(spark, sf), 5)
    return _flat(theta.merge(theta.replicate(best, 3), theta.subset(best, [0, 1])))


@query("WITH s AS (SELECT row_number() OVER (ORDER BY max(c_acctbal) DESC, c_mktsegment) - 1 AS theta_idx, c_mktsegment AS seg FROM customer GROUP BY c_mktsegment), u AS (SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS theta_idx, c_nationkey AS unit, c_custkey FROM customer) SELECT theta_idx, seg, unit, c_custkey FROM s JOIN u USING (theta_idx)")
def mix_and_match(spark, sf):
    customers = series.read_table(spark, sf, "customer")
    segs = customers.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("loglik")).select(F.col("c_mktsegment").alias("theta_idx"), "loglik", F.col("c_mktsegment").alias("seg"))
    units = customers.select(F.col("c_custkey").alias("theta_idx"), F.col("c_nationkey").alias("unit"), F.col("c_acctbal").alias("loglik"), "c_custkey")
    s, u = theta.mix_and_match(segs, units)
    return s.select("theta_idx", "seg").join(u.select("theta_idx", "unit", "c_custkey"), "theta_idx").withColumn("theta_idx", F.col("theta_idx").cast("bigint"))


@query(f"SELECT i AS theta_idx, round(0.1 + 0.9 * {HASH.format(chr(39) + '7|' + chr(39) + ' || i || ' + chr(39) + '|A' + chr(39))}, 9) AS a, round(-2 + 5 * {HASH.format(chr(39) + '7|' + chr(39) + ' || i || ' + chr(39) + '|B' + chr(39))}, 9) AS b FROM (SELECT unnest(range(500)) AS i)")
def sample_params(spark, sf):
    out = theta.sample(spark, {"A": (0.1, 1.0), "B": (-2.0, 3.0)}, 500, 7)
    return out.select(F.col("theta_idx").cast("bigint").alias("theta_idx"), F.round(F.col("params")["A"], 9).alias("a"), F.round(F.col("params")["B"], 9).alias("b"))


@query("SELECT n_name AS unit, 'b' AS parameter, n_nationkey::DOUBLE AS value FROM nation UNION ALL SELECT n_name, 'a', 1.5 FROM nation")
def unit_parameters(spark, sf):
    units = series.read_table(spark, sf, "nation")
    shared = spark.createDataFrame([(0, "a", 1.5)], "theta_idx int, parameter string, value double")
    own = units.select(F.lit(0).alias("theta_idx"), F.col("n_name").alias("unit"), F.lit("b").alias("parameter"), F.col("n_nationkey").cast("double").alias("value"))
    return theta.unit_parameters(shared, own, units.select(F.col("n_name").alias("unit"))).drop("theta_idx")


def _schedule(spark, column):
    return spark.range(200).select(F.col("id").alias("i"), F.round(column(F.col("id")), 9).alias("v"))


_I = "FROM (SELECT unnest(range(200)) AS i)"


@query(f"SELECT i, round(pow(0.5, i / 50.0), 9) AS v {_I}")
def cooling_geometric(spark, sf):
    return _schedule(spark, lambda i: schedules.cooling_geometric(i, 0.5))


@query(f"SELECT i, round(0.1 + 0.9 * (1 + cos(pi() * i / 200)) / 2, 9) AS v {_I}")
def cooling_cosine(spark, sf):
    return _schedule(spark, lambda i: schedules.cooling_cosine(i.cast("double"), 200, 0.1))


@query(f"SELECT i, round(1 / (1 + 0.3 * i), 9) AS v {_I}")
def cooling_hyperbolic(spark, sf):
    return _schedule(spark, lambda i: schedules.cooling_hyperbolic(i, 0.3))


@query(f"SELECT i, round(0.2 + 0.8 * (1 + cos(pi() * i / 200)) / 2, 9) AS v {_I}")
def decay_cosine(spark, sf):
    return _schedule(spark, lambda i: schedules.cosine_decay(i, 200, 0.2))


@query(f"SELECT i, round(pow(0.98, i), 9) AS v {_I}")
def decay_geometric(spark, sf):
    return _schedule(spark, lambda i: schedules.geometric_decay(i, 0.98))


@query(f"SELECT i, round(1 - 0.7 * i / 199.0, 9) AS v {_I}")
def decay_linear(spark, sf):
    return _schedule(spark, lambda i: schedules.linear_decay(i, 200, 0.3))


@query(f"SELECT i, round(1 / (1 + 0.05 * i), 9) AS v {_I}")
def decay_hyperbolic(spark, sf):
    return _schedule(spark, lambda i: schedules.hyperbolic_decay(i, 0.05))


def _reps(spark, sf):
    lines = series.read_table(spark, sf, "lineitem")
    return lines.select((F.col("l_partkey") % 20).alias("theta_idx"), F.col("l_shipmode" if "l_shipmode" in lines.columns else "l_returnflag").alias("unit"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("rep"), (-F.col("l_quantity") / 7).alias("loglik"))


_REPS = "r AS (SELECT l_partkey % 20 AS theta_idx, l_returnflag AS unit, -l_quantity / 7 AS ll FROM lineitem), m AS (SELECT *, max(ll) OVER (PARTITION BY theta_idx, unit) AS mx, count(*) OVER (PARTITION BY theta_idx, unit) AS n FROM r), s AS (SELECT *, sum(exp(ll - mx)) OVER (PARTITION BY theta_idx, unit) AS t FROM m), j AS (SELECT theta_idx, unit, n, mx + ln(t / n) AS ull, ln((t - exp(ll - mx)) / (n - 1)) AS j FROM s), u AS (SELECT theta_idx, unit, any_value(ull) AS ull, sqrt(any_value(n) - 1) * stddev_pop(j) AS use FROM j GROUP BY 1, 2)"


@query(f"WITH {_REPS} SELECT theta_idx, round(sum(ull) OVER (PARTITION BY theta_idx), 5) AS shared_loglik, round(sqrt(sum(use * use) OVER (PARTITION BY theta_idx)), 5) AS shared_se, unit, round(ull, 5) AS unit_loglik, round(use, 5) AS unit_se FROM u")
def panel_loglik_total(spark, sf):
    return rounded(results.panel_results(_reps(spark, sf)), 5)


@query(f"WITH {_REPS} SELECT coalesce(unit, '[[TOTAL]]') AS unit, round(sum(ull), 4) AS loglik FROM u WHERE theta_idx = 3 GROUP BY ROLLUP (unit)")
def panel_totals_first(spark, sf):
    per = results.panel_results(_reps(spark, sf)).where("theta_idx = 3").select("unit", F.col("unit_loglik").alias("loglik"))
    return rounded(results.totals_first(per), 4)


def _traces(spark, sf):
    lines = series.read_table(spark, sf, "lineitem")
    return lines.select((F.col("l_linenumber") - 1).cast("int").alias("run_id"), F.col("l_partkey").alias("theta_idx"), (F.col("l_orderkey") % 50).alias("iteration"), F.col("l_quantity").alias("loglik"), (F.col("l_discount") > 0.05).alias("accepted"))


@query("WITH t AS (SELECT l_linenumber - 1 AS run_id, l_partkey AS theta_idx, l_orderkey % 50 AS iteration, l_quantity AS loglik FROM lineitem), n AS (SELECT run_id, max(iteration) AS len FROM t GROUP BY 1), b AS (SELECT run_id, sum(len) OVER (ORDER BY run_id) - len AS shift FROM n) SELECT run_id, theta_idx, (iteration + shift)::BIGINT AS iteration, loglik FROM t JOIN b USING (run_id)")
def traces_renumber(spark, sf):
    return results.renumbered_traces(_traces(spark, sf)).drop("accepted").withColumn("iteration", F.col("iteration").cast("bigint"))


@query("SELECT l_partkey AS theta_idx, round(avg((l_discount > 0.05)::INT), 6) AS rate FROM lineitem WHERE l_orderkey % 50 > 0 GROUP BY 1")
def acceptance_rate(spark, sf):
    return rounded(results.acceptance_rate(_traces(spark, sf)))


@query("SELECT o_custkey AS theta_idx, max(o_orderkey) AS iteration, max_by(o_totalprice, o_orderkey) AS loglik FROM orders GROUP BY 1")
def last_iteration(spark, sf):
    traces = series.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("theta_idx"), F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("loglik"))
    return results.last_iteration(traces)


@query("SELECT o_custkey AS theta_idx, o_orderkey AS iteration, variable, value FROM (UNPIVOT (SELECT o_custkey, o_orderkey, o_totalprice AS loglik, length(o_orderpriority)::DOUBLE AS p FROM orders) ON loglik, p INTO NAME variable VALUE value)")
def trace_plot(spark, sf):
    traces = series.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("theta_idx"), F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("loglik"), F.length("o_orderpriority").cast("double").alias("p"))
    return results.trace_plot(traces, ["p"])


@query("SELECT l_linenumber AS time, round(quantile_cont(l_extendedprice, 0.05), 4) AS q5, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY 1")
def quantile_bands(spark, sf):
    return rounded(stats.quantile_bands(series.read_table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "time"), ["time"], "l_extendedprice"), 4)


@query("WITH s AS (SELECT n_regionkey AS theta_idx, n_nationkey AS sim, avg(c_acctbal) AS mean, max(c_acctbal) AS top FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), d AS (SELECT avg(c_acctbal) AS mean, max(c_acctbal) AS top FROM customer) SELECT probe, round(value, 5) AS value, false AS is_real_data, theta_idx, sim FROM (UNPIVOT s ON mean, top INTO NAME probe VALUE value) UNION ALL SELECT probe, round(value, 5), true, NULL, NULL FROM (UNPIVOT d ON mean, top INTO NAME probe VALUE value)")
def probe_summary(spark, sf):
    customers = series.read_table(spark, sf, "customer").join(series.read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sims = customers.select(F.col("n_regionkey").cast("int").alias("theta_idx"), F.col("n_nationkey").cast("int").alias("sim"), "c_acctbal")
    return rounded(results.probes(sims, customers, {"mean": F.avg("c_acctbal"), "top": F.max("c_acctbal")}), 5)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE (1 - exp(-(l_discount + l_tax) * 2)) * l_discount / (l_discount + l_tax) END, 9) AS p0, round(CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE (1 - exp(-(l_discount + l_tax) * 2)) * l_tax / (l_discount + l_tax) END, 9) AS p1, round(exp(-(l_discount + l_tax) * 2), 9) AS stay FROM lineitem")
def euler_multinom_probs(spark, sf):
    lines = series.read_table(spark, sf, "lineitem")
    *exits, stay = euler_exit_probabilities([F.col("l_discount"), F.col("l_tax")], F.lit(2.0))
    return rounded(lines.select("l_orderkey", F.col("l_linenumber"), *[p.alias(f"p{i}") for i, p in enumerate(exits)], stay.alias("stay")), 9)


@query("SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 9) AS log_q, round(ln(x / (1 - x)), 9) AS logit_x, round(x, 9) AS back FROM (SELECT *, (l_discount + 0.013) / 0.2 AS x FROM lineitem)")
def transform_roundtrip(spark, sf):
    x = (F.col("l_discount") + 0.013) / 0.2
    return rounded(series.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.log("l_quantity").alias("log_q"), stats.logit(x).alias("logit_x"), stats.expit(stats.logit(x)).alias("back")), 9)


_N = HASH.format("'9|' || i || '|' || t || '|r'"), HASH.format("'9|' || i || '|' || t || '|phi'")


@query(f"WITH RECURSIVE z AS (SELECT i, t, sqrt(-2 * ln({_N[0]})) * cos(2 * pi() * {_N[1]}) AS z FROM (SELECT unnest(range(50)) AS i) JOIN (SELECT unnest(range(1, 21)) AS t) ON true), s(i, t, x) AS (SELECT i, 0::BIGINT, 0.0::DOUBLE FROM (SELECT unnest(range(50)) AS i) UNION ALL SELECT z.i, z.t, 0.8 * x + 0.3 * z FROM s JOIN z ON z.i = s.i AND z.t = s.t + 1) SELECT i AS sim, t AS time, round(x, 6) AS x FROM s")
def simulate_replayable(spark, sf):
    """Linear Gaussian paths with hash normals: the shocks' discounted sums, folded inside the JVM."""
    each = spark.range(50).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"))).alias("t")).withColumn("z", hash_normal(F.lit(9), "i", "t"))
    paths = each.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("zs"))
    step = lambda acc, o: F.array_append(acc, F.struct(o["t"].alias("t"), (0.8 * F.element_at(acc, -1)["x"] + 0.3 * o["z"]).alias("x")))
    start = F.array(F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0.0).alias("x")))
    return rounded(paths.select(F.col("i").alias("sim"), F.explode(F.aggregate("zs", start, step)).alias("p")).select("sim", F.col("p.t").alias("time"), F.col("p.x").alias("x")))


@query("WITH t AS (SELECT c_custkey AS theta_idx, c_acctbal AS loglik FROM customer), r AS (SELECT c_custkey % 100 AS theta_idx, round(sum(c_acctbal), 3) AS ll FROM customer GROUP BY 1) SELECT r.theta_idx, ll AS loglik, t.loglik AS k FROM r LEFT JOIN t ON t.theta_idx = r.theta_idx")
def results_with_parameters(spark, sf):
    customers = series.read_table(spark, sf, "customer")
    found = customers.groupBy((F.col("c_custkey") % 100).alias("theta_idx")).agg(F.round(F.sum("c_acctbal"), 3).alias("loglik"))
    sets = customers.select(F.col("c_custkey").alias("theta_idx"), F.create_map(F.lit("k"), "c_acctbal").alias("params"))
    return results.with_parameters(found, sets, ["k"])


@query(f"WITH {PARTICLES}, m AS (SELECT idx % 7 AS theta_idx, g AS time, lw, max(lw) OVER (PARTITION BY idx % 7, g) AS mx, x FROM p) SELECT theta_idx, time, round(any_value(mx) + ln(avg(exp(lw - mx))), 6) AS cll, round(avg(x), 6) AS ess FROM m GROUP BY 1, 2")
def cll_and_ess_by_time(spark, sf):
    steps = particles(spark, sf).select((F.col("idx") % 7).alias("theta_idx"), F.col("g").alias("time"), F.col("lw").alias("cll"), F.col("x").alias("ess"))
    return rounded(results.cll(steps).withColumnRenamed("value", "cll").join(results.ess(steps).withColumnRenamed("value", "ess"), ["theta_idx", "time"]))


@query(f"WITH {POINTS}, u AS (SELECT t, (t % 52) / 52 * 3 AS x FROM pts) SELECT t, round(CASE WHEN x < 1 THEN x ELSE 0 END + CASE WHEN x >= 1 AND x < 2 THEN 2 - x ELSE 0 END, 6) AS b0, round(CASE WHEN x >= 1 AND x < 2 THEN x - 1 WHEN x >= 2 THEN 3 - x ELSE 0 END, 6) AS b1, round(CASE WHEN x >= 2 THEN x - 2 WHEN x < 1 THEN 1 - x ELSE 0 END, 6) AS b2 FROM u")
def periodic_bspline(spark, sf):
    return rounded(_points(spark).select("t", *[b.alias(f"b{i}") for i, b in enumerate(grid.periodic_bspline(F.col("t"), 3, 1, 52.0))]))


@query("SELECT c_nationkey AS k, round(avg(x), 6) AS mean_x, count(*) AS n FROM (SELECT *, c_custkey / 100.0 AS x FROM customer) GROUP BY 1")
def swarm_mean(spark, sf):
    swarm = series.read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") / 100.0).alias("x"))
    return rounded(swarm.groupBy("k").agg(F.avg("x").alias("mean_x"), F.count("*").alias("n")))


@query("""WITH s AS (SELECT l_linenumber AS g, sum(1.0) AS n, sum(-x * x) AS u, sum(x) AS v, sum(x * x * x * x) AS uu, sum(-x * x * x) AS uv, sum(x * x) AS vv, sum(y) AS z, sum(-x * x * y) AS uz, sum(x * y) AS vz
FROM (SELECT l_linenumber, l_quantity / 50 AS x, l_extendedprice / 1e5 AS y FROM lineitem) GROUP BY 1),
d AS (SELECT *, n * (uu * vv - uv * uv) - u * (u * vv - uv * v) + v * (u * uv - uu * v) AS det FROM s)
SELECT g, round((n * (uz * vv - uv * vz) - z * (u * vv - uv * v) + v * (u * vz - uz * v)) / det, 4) AS a, round((n * (uu * vz - uz * uv) - u * (u * vz - uz * v) + z * (u * uv - uu * v)) / det, 4) AS b, round((z * (uu * vv - uv * uv) - u * (uz * vv - uv * vz) + v * (uz * uv - uu * vz)) / det, 4) AS c FROM d""")
def local_quadratic(spark, sf):
    points = series.read_table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("g"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"))
    return rounded(profiles.local_quadratic(points, ["g"], "x", "y"), 4)


@query("SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, seg LIMIT 3")
def top_results(spark, sf):
    counts = series.read_table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    return results.top(counts.withColumn("loglik", F.col("n") - F.ascii("seg") / 1000), 3).drop("loglik")

