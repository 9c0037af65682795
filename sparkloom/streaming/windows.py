"""Streams: windowed counts with late data bounded by a watermark, and drift of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import drift


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive; ts is a timestamp, as watermarks need one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(by, start, n, total) of each window; a window closes when the watermark has passed it."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), by)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("session_window.start").alias("start"), "n", "total")


def drift_sink(reference: DataFrame, numeric: list[str], levels: list[str], keep: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the stability report of each micro-batch against the reference, given to keep."""

    def run(batch: DataFrame, epoch: int) -> None:
        if batch.limit(1).count():
            keep(drift.report(reference, batch, numeric, levels).withColumn("epoch", F.lit(epoch)), epoch)

    return run
