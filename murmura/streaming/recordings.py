"""Recording analyses on streams: the batch functions' counts, kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def hourly_counts(events: DataFrame, ts: str = "ts", by: list[str] | None = None, late: str = "2 hours") -> DataFrame:
    """(hour_start, …, n): tumbling hours; events later than ``late`` are left out and finished hours leave the state."""
    w = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    keys = [F.col(c) for c in by or []]
    return w.groupBy(F.window("at", "1 hour"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour_start"), *keys, "n")


def moving_averages(events: DataFrame, value: str = "value", ts: str = "ts", width: str = "1 hour", slide: str = "10 minutes", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Mean value over sliding windows."""
    w = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    keys = [F.col(c) for c in by or []]
    return w.groupBy(F.window("at", width, slide), *keys).agg(F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "mean")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each key once within the time that late events may take."""
    return events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")
