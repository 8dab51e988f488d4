"""Systematic resampling as window sums and an explode: no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def systematic(particles: DataFrame, by: list[str], order: str, lw: str, u: Column) -> DataFrame:
    """(by..., slot, idx): for each of J slots the drawn particle.

    Slot m takes the particle whose share of the cumulated weights holds (u + m) / J, so a
    particle takes the slots from ceil(J c_before - u) on: a sequence, exploded. ``u`` is one
    uniform a group, ``order`` a unique particle number.
    """
    group = Window.partitionBy(*by)
    top = F.max(lw).over(group)
    weight = F.exp(F.col(lw) - F.when(top == float("-inf"), 0.0).otherwise(top))
    weighed = particles.select(*by, F.col(order).alias("idx"), weight.alias("w"), u.alias("u"))
    summed = weighed.select("*", F.sum("w").over(group.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("c"), F.sum("w").over(group).alias("all"), F.count("*").over(group).alias("j"), F.max("idx").over(group).alias("last"))
    cut = lambda c: F.ceil(c / F.col("all") * F.col("j") - F.col("u"))
    hi = F.when(F.col("idx") == F.col("last"), F.col("j")).otherwise(F.least(cut(F.col("c")), F.col("j")))
    lo = F.coalesce(F.lag(hi).over(group.orderBy("idx")), F.lit(0))
    placed = summed.select(*by, "idx", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    return placed.select(*by, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("slot"), "idx")
