"""Distinct counts that merge: a state per day, kept in storage, from which the actives of any span of days are counted.

A state is exact for whole numbers (bitmaps of 32,768 values each, so a day with very many users is many small rows) or
estimated for any type (one sketch a day). Merging is idempotent: a batch that is written again, or a user seen in
several batches, changes nothing. Days of late batches simply get further states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Logarithm of a sketch's registers; the relative error is about 1.04 / sqrt(2 ** SKETCH_BITS), 1.6 per cent.
SKETCH_BITS = 12


def day_bitmaps(df: DataFrame, time_column: str, user: str) -> DataFrame:
    """Exact states (day, bucket, users): the bitmap of the whole numbers of one bucket seen on one day.

    Rows without a time or a user count nowhere. Bitmaps are made before the shuffle, so a user who owns a third of all rows
    costs a bit per task.
    """
    if not isinstance(df.schema[user].dataType, T.IntegralType):
        raise TypeError(f"{user}: bitmaps need whole numbers; other types take day_sketches")
    rows = df.where(F.col(user).isNotNull() & F.col(time_column).isNotNull())
    return rows.groupBy(F.to_date(time_column).alias("day"), F.bitmap_bucket_number(F.col(user)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(user))).alias("users"))


def day_sketches(df: DataFrame, time_column: str, user: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Estimating states (day, users): one HyperLogLog sketch a day, of whole numbers, texts or binaries."""
    rows = df.where(F.col(user).isNotNull() & F.col(time_column).isNotNull())
    return rows.groupBy(F.to_date(time_column).alias("day")).agg(F.hll_sketch_agg(user, bits).alias("users"))


def save_states(states: DataFrame, path: str, batch: int) -> None:
    """Keep the states of one batch; a replay of the batch replaces them."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def compacted(states: DataFrame) -> DataFrame:
    """One state per day (and bucket) from those of several batches; counts stay the same."""
    if "bucket" in states.columns:
        return states.groupBy("day", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return states.groupBy("day").agg(F.hll_union_agg("users").alias("users"))


def rolling_actives(states: DataFrame, spans: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """Per day and span: day, span, users, the distinct users of the ``span`` days that end with ``day``.

    A day without rows of its own is reported as long as a span reaches back to one with rows. States are merged over days first and
    then reach each span's days, never the rows behind them: a state is repeated once per day of each span. An empty table gives an empty result.
    """
    last = states.agg(F.max("day")).first()[0]
    reach = F.array(*[F.lit(s) for s in spans])
    to = F.explode(F.sequence("day", F.least(F.expr("date_add(day, span - 1)"), F.lit(last).cast("date")), F.expr("interval 1 day")))
    placed = compacted(states).withColumn("span", F.explode(reach)).withColumn("_to", to)
    if "bucket" in states.columns:
        parts = placed.groupBy(F.col("_to").alias("day"), "span", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
        return parts.groupBy("day", "span").agg(F.sum(F.bitmap_count("users")).alias("users"))
    merged = placed.groupBy(F.col("_to").alias("day"), "span").agg(F.hll_union_agg("users").alias("users"))
    return merged.withColumn("users", F.hll_sketch_estimate("users"))
