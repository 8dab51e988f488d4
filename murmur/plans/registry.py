"""Registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmur.plans import particle_queries, replay_queries, sql_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**sql_queries.QUERIES, **particle_queries.QUERIES, **replay_queries.QUERIES}
ORACLES: dict[str, str] = {**sql_queries.ORACLES, **replay_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that the smoke check runs: the exact filter of the daily order totals."""
    return sql_queries.kalman_loglik(spark, sf_dir)
