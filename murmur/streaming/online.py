"""Structured Streaming: windowed counts, and the bootstrap filter with its swarm as state.

The engine's batch filter loops over a whole series; here the same step runs as
observations arrive. A key's observations are filtered in time order within a batch;
one that is not later than what the key has seen is late and dropped.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from murmur.functions.rng import generator
from murmur.operators.kernels import normalised, systematic
from murmur.operators.models import Model


def hourly_counts(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """(series_id, start, n, value) of tumbling hours; hours close once the watermark passes."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("series_id")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counts.select("series_id", F.col("w.start").alias("start"), "n", "value")


class _Filter(StatefulProcessor):
    def __init__(self, blob: bytes, theta: dict, particles: int, seed: int):
        self.blob, self.theta, self.particles, self.seed = blob, theta, particles, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model: Model = pickle.loads(self.blob)
        self.state = handle.getValueState("swarm", StructType([StructField("swarm", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues):
        (unit,) = key
        frame = pd.concat(list(rows)).sort_values("time")
        if self.state.exists():
            x, last, steps = pickle.loads(self.state.get()[0])
        else:
            x, last, steps = self.model.rinit(self.theta, {}, 0.0, self.particles, generator(self.seed, unit, 0)), -np.inf, 0
        out = []
        for row in frame.itertuples(index=False):
            if row.time <= last:
                continue
            last, steps = row.time, steps + 1
            rng = generator(self.seed, unit, steps)
            x = self.model.rproc(x, self.theta, {}, row.time, 1.0, rng)
            y = {o: getattr(row, o) for o in self.model.observed}
            lw, cll = normalised(self.model.dmeas(y, x, self.theta, {}, row.time) - np.log(self.particles))
            w = np.exp(lw)
            out.append((unit, row.time, cll, float(1 / np.sum(w * w)), float(w @ x[self.model.states[0]])))
            idx = systematic(lw, rng)
            x = {n: v[idx] for n, v in x.items()}
        self.state.update((pickle.dumps((x, last, steps)),))
        yield pd.DataFrame(out, columns=["series_id", "time", "cll", "ess", "filter_mean"])

    def close(self) -> None:
        pass


def online_filter(stream: DataFrame, model: Model, theta: dict[str, float], *, particles: int = 500, seed: int = 1) -> DataFrame:
    """(series_id, time, cll, ess, filter_mean of the first state) as (series_id, time, observed...) arrive."""
    from pyspark import cloudpickle

    schema = "series_id string, time double, cll double, ess double, filter_mean double"
    return stream.groupBy("series_id").transformWithStateInPandas(_Filter(cloudpickle.dumps(model), theta, particles, seed), schema, "Append", "None")
