"""Parameter sets as tables.

A set is a row (theta_idx, loglik, params map<string,double>); a panel has
theta_shared (theta_idx, parameter, value) and theta_unit (theta_idx, unit, parameter, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.rng import hash_uniform


def from_dicts(spark: SparkSession, sets: list[dict[str, float]], loglik: list[float] | None = None) -> DataFrame:
    """Sets in the order given. All have the names of the first; values are floats, not booleans."""
    names = list(sets[0])
    for one in sets:
        if set(one) != set(names):
            raise ValueError("every set needs the same parameters")
        if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in one.values()):
            raise TypeError("parameter values are numbers")
    rows = [(i, float(loglik[i]) if loglik else None, {n: float(one[n]) for n in names}) for i, one in enumerate(sets)]
    return spark.createDataFrame(rows, "theta_idx int, loglik double, params map<string,double>")


def sample(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int, seed: int) -> DataFrame:
    """n sets of independent uniforms within bounds; a function of seed, set and name alone."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("theta_idx"))
    pairs = [x for name, (lo, hi) in bounds.items() for x in (F.lit(name), F.lit(float(lo)) + (hi - lo) * hash_uniform(F.lit(seed), "theta_idx", F.lit(name)))]
    return rows.select("theta_idx", F.lit(None).cast("double").alias("loglik"), F.create_map(*pairs).alias("params"))


def sample_panel(spark: SparkSession, shared: dict[str, tuple[float, float]], specific: dict[str, tuple[float, float]], units: list[str], n: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Long tables of shared and unit-specific uniforms."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("theta_idx"))

    def drawn(df: DataFrame, bounds: dict, *keys: str) -> DataFrame:
        box = F.explode(F.array(*[F.struct(F.lit(k).alias("parameter"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in bounds.items()]))
        return df.select("*", box.alias("b")).select(*df.columns, "b.parameter", (F.col("b.lo") + (F.col("b.hi") - F.col("b.lo")) * hash_uniform(F.lit(seed), *keys, "b.parameter")).alias("value"))

    each = rows.select("theta_idx", F.explode(F.array(*[F.lit(u) for u in units])).alias("unit"))
    return drawn(rows, shared, "theta_idx"), drawn(each, specific, "theta_idx", "unit")


def renumbered(df: DataFrame, *order) -> DataFrame:
    """theta_idx 0, 1, ... in the given order."""
    return df.withColumn("theta_idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def prune(theta: DataFrame, n: int, *, refill: bool = False) -> DataFrame:
    """The n sets of the largest loglik (NaN and null last, ties by theta_idx), renumbered.

    A top-n by sort and limit: each task keeps n rows. With refill, ranks repeat in turn
    up to the former number of sets.
    """
    score = F.when(F.isnan("loglik") | F.col("loglik").isNull(), float("-inf")).otherwise(F.col("loglik"))
    best = theta.withColumn("_s", score).orderBy(F.desc("_s"), "theta_idx").limit(n)
    ranked = renumbered(best, F.desc("_s"), "theta_idx").drop("_s")
    if not refill:
        return ranked
    total = theta.agg(F.count("*").alias("k")).scalar()
    size = ranked.agg(F.count("*").alias("k")).scalar()
    grown = ranked.withColumn("slot", F.explode(F.sequence(F.col("theta_idx").cast("bigint"), F.greatest(total - 1, F.col("theta_idx").cast("bigint")), size)))
    return grown.withColumn("theta_idx", F.col("slot").cast("int")).drop("slot")


def subset(theta: DataFrame, indices: list[int]) -> DataFrame:
    """The chosen sets in the chosen order, renumbered."""
    place = F.create_map(*[x for i, t in enumerate(indices) for x in (F.lit(t), F.lit(i))])
    return theta.where(F.col("theta_idx").isin(indices)).withColumn("theta_idx", place[F.col("theta_idx")])


def replicate(theta: DataFrame, times: int) -> DataFrame:
    """The whole list of sets so many times over."""
    n = theta.agg((F.max("theta_idx") + 1).alias("n")).scalar()
    return theta.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("theta_idx", (F.col("theta_idx") + F.col("r") * n).cast("int")).drop("r")


def merge(*sets: DataFrame) -> DataFrame:
    """One list of sets after the other, renumbered."""
    out = None
    for part in sets:
        if out is None:
            out = part
            continue
        base = out.agg((F.max("theta_idx") + 1).alias("n")).scalar()
        out = out.unionByName(part.withColumn("theta_idx", (F.col("theta_idx") + base).cast("int")))
    return out


def mix_and_match(shared: DataFrame, unit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared sets ranked by total loglik, unit sets by their unit's loglik, paired by rank.

    shared: (theta_idx, loglik, params); unit: (theta_idx, unit, loglik, params).
    """
    w = Window.orderBy(F.desc(F.nanvl("loglik", F.lit(float("-inf")))), "theta_idx")
    of_unit = Window.partitionBy("unit").orderBy(F.desc(F.nanvl("loglik", F.lit(float("-inf")))), "theta_idx")
    rank = lambda df, window: df.withColumn("_r", (F.row_number().over(window) - 1).cast("int")).drop("theta_idx").withColumnRenamed("_r", "theta_idx")
    return rank(shared, w), rank(unit, of_unit)


def unit_parameters(shared: DataFrame, unit: DataFrame, units: DataFrame) -> DataFrame:
    """(theta_idx, unit, parameter, value) of every unit: its own and the shared ones."""
    spread = shared.join(F.broadcast(units.select("unit").distinct()))
    return unit.select("theta_idx", "unit", "parameter", "value").unionByName(spread.select("theta_idx", "unit", "parameter", "value"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repetitions included; maps are compared by their entries."""
    plain = lambda df: df.select(*[F.array_sort(F.map_entries(c)).alias(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes])
    a, b = plain(a), plain(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
