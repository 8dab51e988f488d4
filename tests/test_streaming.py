import pytest
from pyspark.sql import functions as F

from murmur.operators.models import linear_gaussian
from murmur.plans.particle_queries import START
from murmur.streaming import online


def drained(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_hourly_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = drained(online.hourly_counts(stream), "hourly")
    batch = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("series_id")).count()
    joined = got.join(batch, ["series_id", "start"])
    assert got.count() > 0 and joined.where("n <> count").count() == 0 and joined.count() == got.count()


def test_online_filter(spark, tmp_path):
    rows = [("a", float(t), 0.1 * t) for t in range(1, 6)] + [("b", float(t), 0.0) for t in range(1, 4)]
    spark.createDataFrame(rows, "series_id string, time double, Y1 double").write.parquet(f"{tmp_path}/y")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("series_id string, time double, Y1 double").parquet(f"{tmp_path}/y")
    try:
        got = drained(online.online_filter(stream, linear_gaussian(), START, particles=200), "online")
    except ImportError as error:
        pytest.skip(str(error))
    out = {r.series_id: r.n for r in got.groupBy("series_id").agg(F.count("*").alias("n")).collect()}
    assert out == {"a": 5, "b": 3} and got.where("ess < 1 OR ess > 200").count() == 0
