"""Weekly arrivals as a stream: drop repeated content, count generators per ISO week, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_items(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def first_copies(items: DataFrame, content: str, ts: str = "ts", delay: str = "14 days") -> DataFrame:
    """The first arrival of each content within the delay; older state is forgotten."""
    return (_timed(items, ts).withWatermark(ts, delay).withColumn("content_hash", F.sha1(F.col(content)))
            .dropDuplicatesWithinWatermark(["content_hash"]))


def weekly_census(items: DataFrame, model: str, ts: str = "ts", delay: str = "14 days") -> DataFrame:
    """Items per Monday-based week and generator. Windows of seven days start on a Thursday by default,
    the weekday of 1970-01-01, so they are moved by four days."""
    week = F.window(ts, "7 days", "7 days", "4 days")
    return (_timed(items, ts).withWatermark(ts, delay).groupBy(week.alias("week"), F.col(model).alias("model_name"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("week.start").alias("week_start"), F.col("week.end").alias("week_end"), "model_name", "n"))


def _timed(items: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; a plain one is read in the session's zone."""
    return items.withColumn(ts, F.col(ts).cast("timestamp"))


def append(stream: DataFrame, path: str, checkpoint: str):
    """Everything that is there now, then stop; a restart goes on from the checkpoint."""
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
