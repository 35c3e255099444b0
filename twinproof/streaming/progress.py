"""How far each replica is, counted while its batches are written: position, lag and row counts without a scan of any log.

A batch observes its own rows on their way to the log, and the totals so far are stored by batch number. The observation is taken in the
stage that writes, so a repeated task is counted once, and a replayed batch overwrites its totals as it overwrites its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from twinproof.functions.names import VERSION
from twinproof.operators.reconcile import SIDE, union_replicas
from twinproof.sources.tables import exists

_TOTALS = "batch bigint, position bigint, changes bigint, snapshot bigint, synced bigint"
#: Totals that are kept behind the newest, for readers that have just listed them.
KEPT = 10


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` with their newest version and counts observed by whatever action runs on them first."""
    seen = Observation()
    return rows.observe(
        seen, F.max(VERSION).cast("bigint").alias("position"), F.count(F.lit(1)).alias("changes"),
        F.count_if(F.col(VERSION) == 0).alias("snapshot"), F.count_if(F.col(VERSION) > 0).alias("synced")), seen


def record(spark: SparkSession, path: str, batch_id: int, seen: Mapping) -> None:
    """Add what a batch observed to the totals before it. Totals that miss an earlier batch are refused: they would be wrong for ever."""
    position, counts = seen["position"], [seen[n] for n in ("changes", "snapshot", "synced")]
    if batch_id > 0:
        before = f"{path}/upto={batch_id - 1}"
        if not exists(spark, f"{before}/_SUCCESS"):
            raise RuntimeError(f"{path} holds no totals up to batch {batch_id - 1}: it must begin with the stream")
        last = spark.read.schema(_TOTALS).parquet(before).first()
        position = max((v for v in (position, last["position"]) if v is not None), default=None)
        counts = [n + m for n, m in zip(counts, last[2:])]
    row = spark.createDataFrame([(batch_id, position, *counts)], _TOTALS)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/upto={batch_id}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/upto={batch_id - KEPT}")
    old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals, one row: batch, position, changes (rows of all versions), snapshot (rows of version 0), synced (later ones); none before the first batch."""
    if not exists(spark, path):
        return spark.createDataFrame([], _TOTALS)
    columns = ["batch", "position", "changes", "snapshot", "synced"]
    newest = spark.read.schema(_TOTALS).parquet(path).agg(F.max(F.struct(*columns)).alias("newest"))
    return newest.where("newest IS NOT NULL").select(*[F.col("newest")[c].alias(c) for c in columns])


def status_of_totals(source: DataFrame, replicas: Mapping[str, DataFrame], table: str) -> DataFrame:
    """The columns of ``replication_status`` from the totals of source and replicas; a replica without rows has no line."""
    at = source.first() or {"position": None, "changes": 0, "snapshot": 0}
    position, changes, estimate = (F.lit(at[n]).cast("bigint") for n in ("position", "changes", "snapshot"))
    return union_replicas(replicas).where("changes > 0").select(
        F.col(SIDE).alias("replica"),
        F.lit(table).alias("table"),
        position.alias("source_position"),
        F.col("position").alias("applied_position"),
        (position - F.col("position")).alias("lag"),
        (changes - F.col("changes")).alias("unapplied"),
        F.col("synced").alias("rows_synced"),
        F.col("changes").alias("physical_rows"),
        estimate.alias("source_estimate"),
    )
