"""Integration grid: steps of every observation interval, and covariates interpolated to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Square root of the double precision's epsilon, the slack of an Euler step count.
SLACK = 2.220446049250313e-16**0.5


def euler_steps(t1: Column, t2: Column, dt: Column) -> tuple[Column, Column]:
    """(n, step) of an interval with steps of at most dt: none for an empty interval, one where dt reaches its end."""
    n = F.when(t1 >= t2, 0).when(t1 + dt >= t2, 1).otherwise(F.ceil((t2 - t1) / dt / (1 + SLACK))).cast("int")
    return n, F.when(n > 0, (t2 - t1) / F.greatest(n, F.lit(1))).otherwise(0.0)


def fixed_steps(t1: Column, t2: Column, n: Column) -> tuple[Column, Column]:
    return n.cast("int"), (t2 - t1) / n


def interval_steps(series: DataFrame, t0: float | DataFrame, *, dt: float | None = None, nstep: int | None = None) -> DataFrame:
    """(series_id, obs_idx, t_from, t_to, nstep, dt) of each observation interval.

    Exactly one of dt and nstep is given. Every interval starts from the given dt, also
    after an interval whose steps were shortened.
    """
    if (dt is None) == (nstep is None):
        raise ValueError("exactly one of dt and nstep is needed")
    if isinstance(t0, DataFrame):
        series = series.join(F.broadcast(t0), "series_id")
    else:
        series = series.withColumn("t0", F.lit(float(t0)))
    w = Window.partitionBy("series_id").orderBy("time")
    bounds = series.select("series_id", (F.row_number().over(w) - 1).alias("obs_idx"), F.coalesce(F.lag("time").over(w), "t0").alias("t_from"), F.col("time").alias("t_to"))
    n, step = euler_steps(F.col("t_from"), F.col("t_to"), F.lit(float(dt))) if dt is not None else fixed_steps(F.col("t_from"), F.col("t_to"), F.lit(nstep))
    return bounds.select("*", n.alias("nstep"), step.alias("dt"))


def steps(intervals: DataFrame) -> DataFrame:
    """One row for each sub-step's start and one for the end of the last interval."""
    each = intervals.where("nstep > 0").select("series_id", "obs_idx", F.explode(F.sequence(F.lit(0), F.col("nstep") - 1)).alias("step_idx"), "t_from", "dt")
    each = each.select("series_id", "obs_idx", "step_idx", (F.col("t_from") + F.col("step_idx") * F.col("dt")).alias("t"), "dt")
    last = intervals.groupBy("series_id").agg(F.max(F.struct("obs_idx", "t_to")).alias("x"))
    return each.unionByName(last.select("series_id", (F.col("x.obs_idx") + 1).alias("obs_idx"), F.lit(0).alias("step_idx"), F.col("x.t_to").alias("t"), F.lit(0.0).alias("dt")))


def interpolate(points: DataFrame, knots: DataFrame, columns: list[str], *, order: str = "linear", time: str = "t") -> DataFrame:
    """``points`` with each knot column at ``time``: linear, beyond the ends too, or constant from the knot before.

    A sort of points and knots together in place of a range join: each knot carries the
    segment that starts there (the last one, the segment that ends there), and a point
    takes that of the last knot at or before it, else the first one's.
    """
    if order not in ("linear", "constant"):
        raise ValueError("order is linear or constant")
    by_series = Window.partitionBy("series_id").orderBy("_t")
    marks = knots.select("series_id", F.col("time").alias("_t"), *[F.col(c).cast("double").alias(f"_v_{c}") for c in columns])
    here = F.struct("_t", *[f"_v_{c}" for c in columns])
    segment = F.when(F.lead("_t").over(by_series).isNotNull(), F.struct(here.alias("a"), F.lead(here).over(by_series).alias("b"))).otherwise(F.struct(F.coalesce(F.lag(here).over(by_series), here).alias("a"), here.alias("b")))
    marks = marks.select("series_id", "_t", segment.alias("_seg"), here.alias("_here"), F.lit(0).alias("_kind"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_p"))
    asked = points.select("series_id", F.col(time).alias("_t"), F.lit(None).cast(marks.schema["_seg"].dataType).alias("_seg"), F.lit(None).cast(marks.schema["_here"].dataType).alias("_here"), F.lit(1).alias("_kind"), F.struct("*").alias("_p"))
    merged = marks.unionByName(asked)
    upto = Window.partitionBy("series_id").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("series_id").orderBy("_t", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = merged.select("*", F.coalesce(F.last("_seg", True).over(upto), F.first("_seg", True).over(after)).alias("s"), F.coalesce(F.last("_here", True).over(upto), F.first("_here", True).over(after)).alias("h")).where("_kind = 1")

    def value(c: str) -> Column:
        if order == "constant":
            return F.col(f"h._v_{c}")
        a, b = F.col(f"s.a._v_{c}"), F.col(f"s.b._v_{c}")
        width = F.col("s.b._t") - F.col("s.a._t")
        return F.when(width == 0, b).otherwise(a + (b - a) * (F.col("_t") - F.col("s.a._t")) / width)

    return near.select("_p.*", *[value(c).alias(c) for c in columns])


def full_grid(series: DataFrame, t0: float | DataFrame, knots: DataFrame | None = None, columns: list[str] = (), *, dt: float | None = None, nstep: int | None = None, order: str = "linear") -> DataFrame:
    """(series_id, obs_idx, step_idx, t, dt, covariates...) over every sub-step and the final time."""
    grid = steps(interval_steps(series, t0, dt=dt, nstep=nstep))
    return interpolate(grid, knots, list(columns), order=order) if knots is not None else grid


def periodic_bspline(t: Column, n: int, degree: int, period: float) -> list[Column]:
    """n periodic B-spline basis values at t, by the Cox-de Boor recursion on a uniform wrapped knot grid."""
    width = period / n

    def cardinal(x: Column, d: int) -> Column:
        if d == 0:
            return F.when((x >= 0) & (x < 1), 1.0).otherwise(0.0)
        return x / d * cardinal(x, d - 1) + (d + 1 - x) / d * cardinal(x - 1, d - 1)

    at = F.pmod(t, F.lit(period)) / width
    return [cardinal(F.pmod(at - i, F.lit(float(n))), degree) for i in range(n)]
