"""Models on disk: data and parameter sets as Parquet, functions by the name of their builder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from murmur.operators import models
from murmur.operators.models import Model

BUILDERS = {"linear_gaussian": models.linear_gaussian, "sir": models.sir, "stochastic_volatility": models.stochastic_volatility, "measles": models.measles, "cholera": models.cholera}


def save(path: str, builder: str, settings: dict, tables: dict[str, DataFrame]) -> None:
    """Writes the builder's name and settings and every table (ys, covars, theta, ...) under a folder."""
    if builder not in BUILDERS:
        raise KeyError(f"no model is built by {builder!r}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(builder, json.dumps(settings), sorted(tables))], "builder string, settings string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[Model, dict[str, DataFrame]]:
    row = spark.read.schema("builder string, settings string, tables array<string>").json(f"{path}/model").first()
    return BUILDERS[row.builder](**json.loads(row.settings)), {name: spark.read.parquet(f"{path}/{name}") for name in row.tables}
