"""Scalar and aggregate functions of likelihood work, as Column expressions and DataFrame steps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def softclamp(x: Column, floor: float, sharpness: float) -> Column:
    """A smooth maximum of x and floor."""
    return floor + F.log1p(F.exp((x - floor) * sharpness)) / sharpness


def logmeanexp(df: DataFrame, by: list[str], x: str, *, ignore_nan: bool = False) -> DataFrame:
    """(by..., lme, n, se): log of the mean of exp(x), and its jackknife standard error.

    Three grouped aggregations, each combined in its tasks first: the largest value, the
    shifted sum, and the moments of the means with one left out. Rows meet the row of their
    group by an equi-join, which Spark broadcasts where groups are few. With ignore_nan, the
    mean is over the values that are numbers; otherwise a NaN makes the result NaN. All -inf
    gives -inf. One value has no error (NaN).
    """
    value, low = F.col(x), F.lit(float("-inf"))
    rows = df.where(~F.isnan(value) & value.isNotNull()) if ignore_nan else df
    keys = [f"_k{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], value.alias("_x"))

    def met(groups: DataFrame) -> DataFrame:
        same = functools.reduce(lambda p, q: p & q, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys])
        return rows.alias("r").join(groups.alias("g"), same).select("r.*", *[F.col(f"g.{c}") for c in groups.columns if c not in keys]).withColumn("_e", F.exp(F.col("_x") - F.col("_m")))

    tops = rows.groupBy(*keys).agg(F.max("_x").alias("_top"), F.count("*").alias("_n"))
    shift = F.when((F.col("_top") == low) | F.isnan("_top"), 0.0).otherwise(F.col("_top"))
    sums = met(tops.select(*keys, shift.alias("_m"), "_n")).groupBy(*keys).agg(F.first("_m").alias("_m"), F.first("_n").alias("_n"), F.sum("_e").alias("_s"), F.max(F.when(F.col("_e") < 1, F.col("_x"))).alias("_next"))
    part, others = F.col("_s") - F.col("_e"), F.nullif(F.col("_n") - 1, F.lit(0))
    one_out = F.when(part > 0, F.log(part / others))
    # Where the largest value outweighs all others beyond double precision, leaving it out needs a shift by the next one.
    rest = F.sum(F.when(F.col("_e") < 1, F.exp(F.col("_x") - F.col("_next"))))
    moments = met(sums).groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("_m", "_n", "_s", "_next")], rest.alias("_rest"), F.count(one_out).alias("_light"), F.avg(one_out).alias("_mean"), F.var_pop(one_out).alias("_var"))
    heavy = F.col("_next") - F.col("_m") + F.log(F.col("_rest") / others) - F.col("_mean")
    spread = F.when(F.col("_light") == F.col("_n"), F.col("_var")).when(F.col("_light") == F.col("_n") - 1, (F.col("_var") + heavy * heavy / F.col("_n")) * F.col("_light") / F.col("_n")).otherwise(NAN)
    return moments.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        (F.col("_m") + F.coalesce(F.log(F.col("_s") / F.col("_n")), low)).alias("lme"),
        F.col("_n").alias("n"),
        F.when(F.col("_n") > 1, F.sqrt(F.col("_n") - 1) * F.sqrt(spread)).otherwise(NAN).alias("se"),
    )


def normalise_weights(df: DataFrame, by: list[str], lw: str) -> DataFrame:
    """The rows with ``norm_lw`` and the group's ``log_sum``; if every weight is -inf, log_sum is -inf and weights are even."""
    w = Window.partitionBy(*by)
    x = F.when(F.isnan(lw), float("-inf")).otherwise(F.col(lw))
    top = F.max(x).over(w)
    total = F.sum(F.exp(x - F.when(top == float("-inf"), 0.0).otherwise(top))).over(w)
    collapsed = top == float("-inf")
    log_sum = F.when(collapsed, float("-inf")).otherwise(top + F.log(total))
    return df.select("*", log_sum.alias("log_sum"), F.when(collapsed, -F.log(F.count("*").over(w).cast("double"))).otherwise(x - log_sum).alias("norm_lw"))


def ess(df: DataFrame, by: list[str], norm_lw: str = "norm_lw") -> DataFrame:
    """(by..., ess): effective sample size of normalised log weights."""
    return df.groupBy(*by).agg((1 / F.sum(F.exp(2 * F.col(norm_lw)))).alias("ess"))


def weighted_means(df: DataFrame, by: list[str], columns: list[str], norm_lw: str = "norm_lw") -> DataFrame:
    """(by..., columns...): means under normalised log weights."""
    return df.groupBy(*by).agg(*[F.sum(F.exp(norm_lw) * F.col(c)).alias(c) for c in columns])


def quantile_bands(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(by..., q5, q50, ...): exact interpolated quantiles."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in levels]))
    return df.groupBy(*by).agg(q.alias("_q")).select(*by, *[F.col("_q")[i].alias(f"q{round(x * 100)}") for i, x in enumerate(levels)])
