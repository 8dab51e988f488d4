"""Exact filter of the one-dimensional linear Gaussian model as a fold inside the JVM.

x_t = a x_{t-1} + N(0, q), y_t = c x_t + N(0, r), x_0 ~ N(x0, p0); missing y only predicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMETERS = ("a", "c", "q", "r", "x0", "p0")


def _fold(values: Column, p: dict[str, Column], history: bool) -> Column:
    zero = F.lit(0.0)
    start = F.struct(p["x0"].cast("double").alias("m"), p["p0"].cast("double").alias("v"), zero.alias("ll"), F.array().cast("array<struct<time:double,cll:double,mean:double,pred:double>>").alias("h"))

    def step(s: Column, o: Column) -> Column:
        m = p["a"] * s["m"]
        v = p["a"] * p["a"] * s["v"] + p["q"]
        spread = p["c"] * p["c"] * v + p["r"]
        gap = o["y"] - p["c"] * m
        seen = o["y"].isNotNull() & ~F.isnan(o["y"])
        cll = F.when(seen, -0.5 * (math.log(2 * math.pi) + F.log(spread) + gap * gap / spread)).otherwise(0.0)
        gain = p["c"] * v / spread
        mean = F.when(seen, m + gain * gap).otherwise(m)
        h = F.array_append(s["h"], F.struct(o["time"].alias("time"), cll.alias("cll"), mean.alias("mean"), m.alias("pred"))) if history else s["h"]
        return F.struct(mean.alias("m"), F.when(seen, (1 - gain * p["c"]) * v).otherwise(v).alias("v"), (s["ll"] + cll).alias("ll"), h.alias("h"))

    return F.aggregate(values, start, step)


def run(series: DataFrame, theta: DataFrame, *, y: str = "y", history: bool = False) -> DataFrame:
    """One row for each series and set: loglik, and with history the steps (time, cll, mean, pred).

    theta: (theta_idx, the six parameters). Series and sets meet by broadcasting the sets,
    whose number is checked; the fold of a pair is one expression, so pairs spread over tasks.
    """
    sets = F.broadcast(theta) if theta.count() <= 100_000 else theta
    values = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(F.col("time").cast("double").alias("time"), F.col(y).cast("double").alias("y")))).alias("ys"))
    folded = values.join(sets).withColumn("s", _fold(F.col("ys"), {k: F.col(k) for k in PARAMETERS}, history))
    out = folded.select("series_id", "theta_idx", F.col("s.ll").alias("loglik"), *([F.col("s.h").alias("steps")] if history else []))
    return out


def steps(result: DataFrame) -> DataFrame:
    """(series_id, theta_idx, time, cll, filter_mean, prediction_mean)."""
    return result.select("series_id", "theta_idx", F.inline("steps")).withColumnsRenamed({"mean": "filter_mean", "pred": "prediction_mean"})
