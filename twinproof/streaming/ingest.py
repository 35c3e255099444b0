"""Continuous ingest: change rows from a stream become versions in a log; the live view can also be kept as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from twinproof.functions.clock import month_key
from twinproof.functions.names import DELETED, STREAM_TRIGGER_SECONDS, VERSION
from twinproof.operators.fold import newest
from twinproof.sources.tables import MONTH
from twinproof.streaming.progress import observed, record

BATCH = "batch"


def read_changes(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Changes (or source rows) arriving as Parquet files; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_kafka_changes(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, offsets_per_trigger: int = 100_000
) -> DataFrame:
    """Changes as JSON values of a Kafka topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", offsets_per_trigger)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("c")).select("c.*")


def ingest(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    order_by: Sequence[str] = (),
    time_column: str | None = None,
    continuous: bool = False,
    progress: str | None = None,
) -> StreamingQuery:
    """Append every micro-batch of change rows to the version log at ``path``.

    Each batch owns a folder that a replay overwrites, so a batch repeated after a failure adds nothing. Late rows are
    never dropped: the log has no watermark, only reports do. ``continuous`` keeps running, otherwise the query stops
    once everything available has been read. ``progress`` names a folder for the totals of :mod:`progress`, from the first batch on.
    """

    def store(rows: DataFrame, batch_id: int) -> None:
        spark, seen = rows.sparkSession, None
        if progress:
            rows, seen = observed(rows)
        if time_column:
            rows = rows.withColumn(MONTH, month_key(time_column))
        keys = [*([MONTH] if time_column else []), *order_by]
        if keys:
            rows = rows.sortWithinPartitions(*keys)
        writer = rows.write.mode("overwrite")
        if time_column:
            writer = writer.partitionBy(MONTH)
        writer.parquet(f"{path}/{BATCH}={batch_id}")
        if seen:
            record(spark, progress, batch_id, seen.get)

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    if continuous:
        return writer.trigger(processingTime=f"{STREAM_TRIGGER_SECONDS} seconds").start()
    return writer.trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The version log built by :func:`ingest`, with its ``batch`` number."""
    return spark.read.parquet(path).drop(MONTH)


def latest_state(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """A streaming aggregation that keeps the newest version per key (deletes as flagged rows).

    Spark's own aggregation state: rows of one key are reduced within each task before they meet the state, so a key
    with many changes in a batch costs one state update. Use output mode ``update`` or ``complete``.
    """
    return newest(changes, key, [c for c in changes.columns if c not in key])


def upsert_into_memory(changes: DataFrame, key: Sequence[str], name: str, checkpoint: str) -> StreamingQuery:
    """The current state per key as an in-memory table, for small interactive use."""
    return (
        latest_state(changes, key)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live(state: DataFrame) -> DataFrame:
    return state.where(~F.col(DELETED)).drop(VERSION, DELETED)
