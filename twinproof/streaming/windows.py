"""Windowed counts over a stream. Reports use a watermark: only settled windows are emitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

# The epoch began on a Thursday: Monday weeks start four days in.
_MONDAY_OFFSET = "4 days"


def _windowed(stream: DataFrame, time_column: str, late: str, window: Column, *by: str) -> DataFrame:
    timed = stream.withColumn("_at", F.col(time_column).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(window.alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(stream: DataFrame, time_column: str, late: str = "1 day") -> DataFrame:
    """Rows per UTC day, emitted once no row of that day is expected any more."""
    out = _windowed(stream, time_column, late, F.window("_at", "1 day"))
    return out.select(F.to_date("_w.start").alias("day"), "n")


def weekly_counts(stream: DataFrame, time_column: str, kind: str, late: str = "1 day") -> DataFrame:
    """Rows per Monday week and kind."""
    out = _windowed(stream, time_column, late, F.window("_at", "7 days", "7 days", _MONDAY_OFFSET), kind)
    return out.select(F.to_date("_w.start").alias("week"), kind, "n")


def sliding_counts(
    stream: DataFrame, time_column: str, length: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes"
) -> DataFrame:
    """Rows per sliding window, keyed by the window's end."""
    out = _windowed(stream, time_column, late, F.window("_at", length, step))
    return out.select(F.col("_w.end").cast("timestamp_ntz").alias("until"), "n")


def write_settled(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append settled windows to Parquet; each window is written exactly once."""
    return (
        counts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
