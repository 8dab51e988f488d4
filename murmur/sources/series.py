"""Sources: tables, and observation series and covariates derived from them.

Every series is a DataFrame (series_id, time, values...); time is a double that counts
from the start of the data, so one plan serves a single series and a panel of units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_ZERO = "1992-01-01"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV scan with a declared schema: no pass over the data to infer one."""
    return spark.read.csv(path, schema=schema, header=header)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sink; result tables are partitioned by run."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def from_pandas(spark: SparkSession, ys, series_id: str = "series") -> DataFrame:
    """An in-memory frame whose index is the observation time."""
    frame = ys.rename_axis("time").reset_index()
    frame.insert(0, "series_id", series_id)
    return spark.createDataFrame(frame)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1: (series_id, time, y): log of the day's order total, centred; days without orders are absent."""
    orders = read_table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.log(F.sum("o_totalprice")).alias("v"))
    mean = orders.agg(F.avg("v").alias("m")).scalar()
    return orders.select(F.lit("orders").alias("series_id"), F.datediff("day", F.lit(DAY_ZERO).cast("date")).cast("double").alias("time"), (F.col("v") - mean).alias("y"))


def monthly_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2: (series_id, time, y): monthly log order total by the customer's nation; time in months."""
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.col("o_orderdate"))
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    month = ((F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1).cast("double")
    return joined.groupBy(F.col("n_name").alias("series_id"), month.alias("time")).agg(F.log(F.sum("o_totalprice")).alias("y"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: (series_id, time, n, value): events of each type by hour since 2024-01-01; hours without events are absent."""
    events = read_table(spark, sf_dir, "events")
    hour = F.floor(F.unix_seconds(F.date_trunc("hour", F.col("ts")).cast("timestamp")) / 3600)
    return events.groupBy(F.col("event_type").alias("series_id"), hour.cast("double").alias("time")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def monthly_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4: (series_id, time, y, n): log quantity shipped by month."""
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("double")
    return read_table(spark, sf_dir, "lineitem").groupBy(F.lit("shipments").alias("series_id"), month.alias("time")).agg(F.log(F.sum("l_quantity")).alias("y"), F.count("*").alias("n"))


def unit_subset(series: DataFrame, units: list[str], blank: list[tuple[str, float]] = ()) -> DataFrame:
    """The chosen units; the cells in ``blank`` (unit, time) become null."""
    kept = series.where(F.col("series_id").isin(units))
    hit = F.lit(False)
    for unit, time in blank:
        hit = hit | ((F.col("series_id") == unit) & (F.col("time") == time))
    values = [c for c in series.columns if c not in ("series_id", "time")]
    return kept.select("series_id", "time", *[F.when(~hit, F.col(c)).alias(c) for c in values])


def year_window(dated: DataFrame, first: int, last: int, date: str = "date") -> DataFrame:
    """Rows of the years first to last with decimal time: days since first-01-01 / 365.25 + first, strictly inside."""
    time = F.datediff(F.col(date), F.make_date(F.lit(first), F.lit(1), F.lit(1))) / 365.25 + first
    years = dated.where(F.year(date).between(first, last)).withColumn("time", time)
    return years.where((F.col("time") > first) & (F.col("time") < last + 1))


def wide_to_long(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One row for each unit's column."""
    return wide.unpivot(key, [c for c in wide.columns if c != key], name, value)


def demography(population: DataFrame, births: DataFrame) -> DataFrame:
    """Full outer join of two (unit, year, value) tables."""
    return population.withColumnRenamed("value", "pop").join(births.withColumnRenamed("value", "births"), ["unit", "year"], "full")


def log_returns(series: DataFrame, value: str = "close") -> DataFrame:
    """log(v / previous v) of each series; the first time has none and is dropped."""
    w = Window.partitionBy("series_id").orderBy("time")
    return series.withColumn("y", F.log(F.col(value) / F.lag(value).over(w))).where("y IS NOT NULL").select("series_id", "time", "y")


def lagged_covariate(series: DataFrame, value: str = "y") -> DataFrame:
    """The series as a covariate of itself with a zero row one unit before its start."""
    first = series.groupBy("series_id").agg((F.min("time") - 1).alias("time"))
    return first.select("series_id", "time", F.lit(0.0).alias("y_prev")).unionByName(series.select("series_id", "time", F.col(value).alias("y_prev")))


def start_time(series: DataFrame) -> DataFrame:
    """(series_id, t0): the first time less the first step."""
    two = series.groupBy("series_id").agg(F.array_sort(F.collect_set("time")).alias("ts"))
    return two.select("series_id", (2 * F.get("ts", F.lit(0)) - F.get("ts", F.lit(1))).alias("t0"))


def standardised(units: DataFrame, value: str) -> DataFrame:
    """(unit, z): z-scores of log value over units, sample deviation, 1 where it is zero or missing."""
    x = F.log(value)
    moments = units.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    sd = F.when(F.coalesce("s", F.lit(0.0)) > 0, F.col("s")).otherwise(1.0)
    return units.join(F.broadcast(moments)).select("unit", ((x - F.col("m")) / sd).alias("z"))
