"""Day counts of a stream that never lose a row: reports of settled days, and corrections when rows come after the report.

A watermark drops what comes too late, which no count here may do. Instead every batch counts its rows by day and marks those of days that
had been reported before the batch; such rows are kept beside the counts, and their days restated. All that a batch writes
follows from the batches before it and lies in the batch's own folders, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from .ingest import BATCH

_COUNTS, _LATE, _NEWEST = "counts", "late", "newest"


def _newest_before(spark: SparkSession, path: str, batch_id: int):
    """The newest event time of earlier batches: one small row each."""
    if batch_id == 0:
        return None
    rows = spark.read.schema(f"newest timestamp, {BATCH} bigint").parquet(f"{path}/{_NEWEST}")
    return rows.where(F.col(BATCH) < batch_id).agg(F.max("newest")).first()[0]


def count_days(stream: DataFrame, time_column: str, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Count the stream's rows per UTC day under ``path``; a day is reported once the newest row is ``late`` past its end.

    Rows without a time form the day NULL, which is never reported as settled. Stops once everything available is read.
    """

    def count(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        newest = _newest_before(spark, path, batch_id)
        at = F.col(time_column).cast("timestamp")
        reported = F.lit(False) if newest is None else F.coalesce(
            F.date_trunc("day", at) + F.expr(f"INTERVAL 1 DAY + INTERVAL {late}") <= F.lit(newest), F.lit(False))
        marked = rows.withColumns({"_day": F.to_date(at), "_reported": reported})
        days = marked.groupBy(F.col("_day").alias("day"), F.col("_reported").alias("reported")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("newest"))
        # One row a day: bounded by the calendar.
        days = spark.createDataFrame(days.collect(), "day date, reported boolean, n bigint, newest timestamp").coalesce(1)
        if not days.where("reported").isEmpty():
            marked.where("_reported").drop("_day", "_reported").write.mode("overwrite").parquet(f"{path}/{_LATE}/{BATCH}={batch_id}")
        days.drop("newest").write.mode("overwrite").parquet(f"{path}/{_COUNTS}/{BATCH}={batch_id}")
        days.agg(F.max("newest").alias("newest")).write.mode("overwrite").parquet(f"{path}/{_NEWEST}/{BATCH}={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(count).trigger(availableNow=True).start()


def _counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"day date, reported boolean, n bigint, {BATCH} bigint").parquet(f"{path}/{_COUNTS}")


def reports(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """``day`` and ``n`` of each settled day, as it was first reported."""
    newest = spark.read.schema(f"newest timestamp, {BATCH} bigint").parquet(f"{path}/{_NEWEST}").agg(F.max("newest")).first()[0]
    first = _counts(spark, path).where("NOT reported").groupBy("day").agg(F.sum("n").alias("n"))
    # A day all of whose rows came late was reported without rows.
    days = _counts(spark, path).select("day").distinct().join(first, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return days.where(F.col("day").cast("timestamp") + F.expr(f"INTERVAL 1 DAY + INTERVAL {late}") <= F.lit(newest))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """``day``, ``batch``, ``added``, ``restated``: what later batches added to reported days, and the day's count from then on."""
    rows = _counts(spark, path).where("day IS NOT NULL")
    first = rows.where("NOT reported").groupBy("day").agg(F.sum("n").alias("first"))
    added = rows.where("reported").groupBy("day", BATCH).agg(F.sum("n").alias("added")).join(first, "day", "left")
    # A day's corrections are bounded by the number of batches.
    so_far = F.sum("added").over(Window.partitionBy("day").orderBy(BATCH))
    return added.select("day", BATCH, "added", (F.coalesce("first", F.lit(0)) + so_far).alias("restated"))


def late_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows that came after their day's report, whole, with the batch that brought them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    if _counts(spark, path).where("reported").isEmpty():
        return spark.createDataFrame([], f"{schema}, {BATCH} bigint")
    return spark.read.schema(f"{schema}, {BATCH} bigint").parquet(f"{path}/{_LATE}")
