"""Runs and their payload tables, and the views that users read."""

from __future__ import annotations

import functools
import platform
import time
from collections.abc import Callable
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur import __version__
from murmur.functions.stats import logmeanexp

RUN_SCHEMA = "run_id int, method string, kind string, panel boolean, seconds double, seed bigint, config map<string,string>, engine string, spark string, python string, system string, created_at timestamp"


def run_row(spark: SparkSession, run_id: int, method: str, kind: str, *, panel: bool = False, seconds: float = 0.0, seed: int = 0, config: dict | None = None) -> DataFrame:
    row = (run_id, method, kind, panel, float(seconds), int(seed), {str(k): str(v) for k, v in (config or {}).items()}, __version__, pyspark.__version__, platform.python_version(), platform.system(), datetime.now(timezone.utc))
    return spark.createDataFrame([row], RUN_SCHEMA)


def filter_results(logliks: DataFrame) -> DataFrame:
    """(theta_idx, loglik, se) over replicates of (theta_idx, rep, loglik)."""
    return logmeanexp(logliks, ["theta_idx"], "loglik").select("theta_idx", F.col("lme").alias("loglik"), "se")


def panel_results(logliks: DataFrame) -> DataFrame:
    """(theta_idx, shared_loglik, shared_se, unit, unit_loglik, unit_se) of (theta_idx, unit, rep, loglik).

    A unit's loglik is over its replicates; the panel's is the units' sum, its error the root of the squares' sum.
    """
    unit = logmeanexp(logliks, ["theta_idx", "unit"], "loglik").select("theta_idx", "unit", F.col("lme").alias("unit_loglik"), F.col("se").alias("unit_se"))
    total = unit.groupBy("theta_idx").agg(F.sum("unit_loglik").alias("shared_loglik"), F.sqrt(F.sum(F.col("unit_se") * F.col("unit_se"))).alias("shared_se"))
    return unit.join(total, "theta_idx").select("theta_idx", "shared_loglik", "shared_se", "unit", "unit_loglik", "unit_se")


def with_parameters(results: DataFrame, theta: DataFrame, names: list[str], on: list[str] = ("theta_idx",)) -> DataFrame:
    """The results with a column for each parameter."""
    return results.join(theta.select(*on, *[F.col("params")[n].alias(n) for n in names]), list(on), "left")


def cll(steps: DataFrame, by: list[str] = ("theta_idx",)) -> DataFrame:
    """(by..., time, value): log of the mean over replicates of the conditional likelihood."""
    return logmeanexp(steps, [*by, "time"], "cll").select(*by, "time", F.col("lme").alias("value"))


def ess(steps: DataFrame, by: list[str] = ("theta_idx",)) -> DataFrame:
    return steps.groupBy(*by, "time").agg(F.avg("ess").alias("value"))


def last_iteration(traces: DataFrame, by: list[str] = ("theta_idx",)) -> DataFrame:
    """The rows of each key's last iteration, by a maximum of structs: no window over a trace."""
    rest = [c for c in traces.columns if c not in by]
    return traces.groupBy(*by).agg(F.max_by(F.struct(*rest), "iteration").alias("_r")).select(*by, "_r.*")


def burnt(traces: DataFrame, burn_in: int) -> DataFrame:
    return traces.where(F.col("iteration") > burn_in)


def acceptance_rate(traces: DataFrame, by: list[str] = ("theta_idx",)) -> DataFrame:
    return traces.where("iteration > 0").groupBy(*by).agg(F.avg(F.col("accepted").cast("double")).alias("rate"))


def renumbered_traces(traces: DataFrame) -> DataFrame:
    """Iterations numbered on over runs: each run starts at the last iteration of the runs before, so that one repeats.

    traces: (run_id, theta_idx, iteration, ...). The runs are few; their lengths are summed
    in a window over one row a run.
    """
    lengths = traces.groupBy("run_id").agg(F.max("iteration").alias("len"))
    before = lengths.select("run_id", (F.sum("len").over(Window.orderBy("run_id")) - F.col("len")).alias("shift"))
    return traces.join(F.broadcast(before), "run_id").withColumn("iteration", F.col("iteration") + F.col("shift")).drop("shift")


def panel_traces(shared: DataFrame, unit: DataFrame) -> DataFrame:
    """(theta_idx, unit, iteration, loglik): the units' rows and one named shared an iteration."""
    return shared.select("theta_idx", F.lit("shared").alias("unit"), "iteration", "loglik").unionByName(unit.select("theta_idx", "unit", "iteration", "loglik"))


#: Columns that come first in every table of traces.
_TRACE = ["theta_idx", "unit", "iteration", "method", "loglik", "se"]


def _ordered(df: DataFrame) -> DataFrame:
    first = [c for c in _TRACE if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def _parameters(theta: DataFrame, names: list[str]) -> DataFrame:
    return theta.select("theta_idx", *[F.col("params")[n].alias(n) for n in names])


def filter_view(logliks: DataFrame, theta: DataFrame, names: list[str]) -> DataFrame:
    """(theta_idx, loglik, se, parameters...) of a filter's run."""
    return filter_results(logliks).join(_parameters(theta, names), "theta_idx", "left")


def filter_traces(logliks: DataFrame, theta: DataFrame, names: list[str], method: str = "pfilter") -> DataFrame:
    """The same as a trace of one iteration, number 0."""
    return _ordered(filter_view(logliks, theta, names).withColumns({"iteration": F.lit(0), "method": F.lit(method)}))


def panel_parameters(rows: DataFrame, shared: DataFrame, unit: DataFrame) -> DataFrame:
    """Rows (theta_idx, unit, ...) with a column a shared parameter and, but for unit 'shared', one a unit's own.

    shared: (theta_idx, parameter, value); unit: (theta_idx, unit, parameter, value). The
    names are the few of a model.
    """
    listed = lambda df: sorted(r.parameter for r in df.select("parameter").distinct().collect())
    wide = shared.groupBy("theta_idx").pivot("parameter", listed(shared)).agg(F.first("value"))
    own = unit.groupBy("theta_idx", "unit").pivot("parameter", listed(unit)).agg(F.first("value"))
    return rows.join(wide, "theta_idx", "left").join(own, ["theta_idx", "unit"], "left")


def panel_filter_view(logliks: DataFrame, shared: DataFrame, unit: DataFrame) -> DataFrame:
    """A row a set and unit: the panel's and the unit's loglik with their errors, then all parameters."""
    return panel_parameters(panel_results(logliks), shared, unit)


def panel_filter_traces(logliks: DataFrame, shared: DataFrame, unit: DataFrame, method: str = "pfilter") -> DataFrame:
    """The panel's filter as a trace: a row named shared and one a unit, all of iteration 0."""
    both = panel_results(logliks)
    whole = both.groupBy("theta_idx").agg(F.first("shared_loglik").alias("loglik"), F.first("shared_se").alias("se")).withColumn("unit", F.lit("shared"))
    rows = whole.unionByName(both.select("theta_idx", "unit", F.col("unit_loglik").alias("loglik"), F.col("unit_se").alias("se")))
    return _ordered(panel_parameters(rows, shared, unit).withColumns({"iteration": F.lit(0), "method": F.lit(method)}))


def estimate_view(traces: DataFrame) -> DataFrame:
    """(theta_idx, loglik, se, parameters...) at the last iteration of a run of estimation; it has no error (null)."""
    last = last_iteration(traces).drop("iteration", "series_id", "rep")
    rest = [c for c in last.columns if c not in ("theta_idx", "loglik")]
    return last.select("theta_idx", "loglik", F.lit(None).cast("double").alias("se"), *rest)


def estimate_traces(traces: DataFrame, method: str) -> DataFrame:
    """(theta_idx, iteration, method, loglik, se, parameters...) of a run of estimation."""
    return _ordered(traces.drop("series_id", "rep").withColumns({"method": F.lit(method), "se": F.lit(None).cast("double")}))


def _spread(traces: DataFrame, shared_names: list[str]) -> DataFrame:
    """Units' rows with the shared parameters of their iteration, and the shared rows."""
    shared = traces.where("unit = 'shared'")
    values = shared.select("theta_idx", "iteration", *shared_names)
    units = traces.where("unit <> 'shared'").drop(*shared_names).join(values, ["theta_idx", "iteration"], "left")
    return shared.unionByName(units)


def panel_estimate_view(traces: DataFrame, shared_names: list[str]) -> DataFrame:
    """A row a set and unit at the last iteration: the panel's and the unit's loglik, no errors, all parameters.

    traces: (theta_idx, iteration, unit or 'shared', loglik, parameters...).
    """
    last = traces.join(traces.groupBy("theta_idx").agg(F.max("iteration").alias("iteration")), ["theta_idx", "iteration"], "left_semi")
    total = last.where("unit = 'shared'").select("theta_idx", F.col("loglik").alias("shared_loglik"))
    none = F.lit(None).cast("double")
    rows = _spread(last, shared_names).where("unit <> 'shared'").join(total, "theta_idx").withColumns({"shared_se": none, "unit_se": none}).withColumnRenamed("loglik", "unit_loglik")
    first = ["theta_idx", "iteration", "shared_loglik", "shared_se", "unit", "unit_loglik", "unit_se"]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def panel_estimate_traces(traces: DataFrame, shared_names: list[str], method: str) -> DataFrame:
    """The whole traces of a panel's estimation; units' rows carry the shared parameters too."""
    return _ordered(_spread(traces, shared_names).withColumns({"method": F.lit(method), "se": F.lit(None).cast("double")}))


def chain_view(traces: DataFrame, *, ignore_nan: bool = False) -> DataFrame:
    """(theta_idx, rep, iteration, loglik or distance, log_prior, accepted, parameters...) of Markov chains; ignore_nan drops rows with a value that is none."""
    out = traces.drop("series_id")
    numbers = [c for c, kind in out.dtypes if kind == "double"]
    return out.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in numbers])) if ignore_nan else out


def chain_traces(traces: DataFrame, method: str) -> DataFrame:
    """The chains with method, loglik (null where the method has a distance instead) and se (null)."""
    none = F.lit(None).cast("double")
    out = chain_view(traces).withColumns({"method": F.lit(method), "se": none})
    return _ordered(out if "loglik" in out.columns else out.withColumn("loglik", none))


def summary(results: DataFrame, runs: DataFrame, n: int = 5) -> str:
    """What a console shows of a history: its runs, and the best ``n`` sets."""
    lines = [f"{r.run_id}: {r.method} ({r.kind}), {r.seconds:.1f} s" for r in runs.orderBy("run_id").collect()]
    best = top(results, n).toPandas()
    return "\n".join(["Runs", *lines, "", f"Best {min(n, len(best))} sets by log likelihood", best.to_string(index=False)])


class History:
    """Runs of one series or panel on disk: a row a run, and the run's payload as a table.

    ``add`` writes both; ``payload`` reads a run's table back; ``best`` puts the log
    likelihoods of a filter's run back on the parameter sets, for ``theta.prune`` to rank.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, method: str, kind: str, payload: Callable[[], DataFrame], *, panel: bool = False, seed: int = 0, config: dict | None = None) -> int:
        """Runs ``payload``, writes its rows and the run's row, and returns the run's number."""
        number = self.count()
        began = time.time()
        payload().write.mode("overwrite").parquet(f"{self.path}/payload/{number}")
        row = run_row(self.spark, number, method, kind, panel=panel, seconds=time.time() - began, seed=seed, config=config)
        row.write.mode("overwrite").parquet(f"{self.path}/runs/run={number}")
        return number

    def count(self) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return len(files.listStatus(at)) if files.exists(at) else 0

    def runs(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.path}/runs")

    def payload(self, number: int = -1) -> DataFrame:
        """A run's table; of the last run by default."""
        return self.spark.read.parquet(f"{self.path}/payload/{number if number >= 0 else self.count() + number}")

    def best(self, theta: DataFrame, number: int = -1) -> DataFrame:
        """The parameter sets with the loglik that a filter's run found for them."""
        steps = self.payload(number)
        found = filter_results(steps.groupBy("theta_idx", "rep").agg(F.sum("cll").alias("loglik")))
        return theta.drop("loglik").join(found.select("theta_idx", "loglik"), "theta_idx", "left").select("theta_idx", "loglik", "params")


def trace_plot(traces: DataFrame, names: list[str]) -> DataFrame:
    """(theta_idx, iteration, variable, value): what a facet plot of traces shows."""
    return traces.unpivot(["theta_idx", "iteration"], ["loglik", *names], "variable", "value")


def run_times(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("run_id").alias("history_index"), "method", F.col("seconds").alias("time"))


def merged_runs(*runs: DataFrame) -> DataFrame:
    """Runs of several machines as one: the same method and config each, seconds of the slowest."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("run_id", "method", "kind", "panel").agg(F.max("seconds").alias("seconds"), F.count_distinct(F.to_json("config")).alias("configs"))


def totals_first(per_unit: DataFrame) -> DataFrame:
    """(unit, loglik) with the sum as unit [[TOTAL]]."""
    return per_unit.rollup("unit").agg(F.sum("loglik").alias("loglik")).select(F.coalesce("unit", F.lit("[[TOTAL]]")).alias("unit"), "loglik")


def top(results: DataFrame, n: int) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("loglik")).limit(n)


def probes(simulated: DataFrame, observed: DataFrame, stats: dict) -> DataFrame:
    """(probe, value, is_real_data, theta_idx, sim): statistics (name -> aggregate Column) of each simulation and of the data."""
    names = list(stats)
    sims = simulated.groupBy("theta_idx", "sim").agg(*[stats[n].cast("double").alias(n) for n in names]).unpivot(["theta_idx", "sim"], names, "probe", "value")
    real = observed.agg(*[stats[n].cast("double").alias(n) for n in names]).unpivot([], names, "probe", "value")
    return sims.select("probe", "value", F.lit(False).alias("is_real_data"), "theta_idx", "sim").unionByName(
        real.select("probe", "value", F.lit(True).alias("is_real_data"), F.lit(None).cast("int").alias("theta_idx"), F.lit(None).cast("int").alias("sim"))
    )
