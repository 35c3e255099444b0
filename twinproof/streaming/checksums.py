"""Key-range checksums kept up to date from changes: every batch adds what it changes and nothing is scanned again.

The checksum terms are sums, so a change is worth its new terms minus its old ones. A batch's differences per bucket are written to the
batch's own folder, which a replay overwrites: repeating a batch adds nothing. The current checksums are the sum over folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from twinproof.functions.terms import Term
from twinproof.operators.reconcile import bucket_of
from twinproof.session import scratch

from .ingest import BATCH

BEFORE, AFTER, ROWS = "before", "after", "_n"


def changes_of(log: DataFrame, key: Sequence[str], order: str | Column, deleted: str) -> DataFrame:
    """A version log as changes with both images: structs ``before`` and ``after``, NULL where there is no such row.

    Feeds under full row identity bring both images themselves; this derives them from versions, one shuffle by key.
    """
    from pyspark.sql import Window

    columns = [c for c in log.columns if c != deleted]
    image = F.when(~F.col(deleted), F.struct(*columns))
    before = F.lag(image).over(Window.partitionBy(*key).orderBy(order))
    return log.select(*columns, before.alias(BEFORE), image.alias(AFTER))


def _differences(changes: DataFrame, key: str, terms: Sequence[Term], lo: int, width: int) -> DataFrame:
    def side(image: str, sign: int) -> DataFrame:
        rows = changes.where(F.col(image).isNotNull()).select(f"{image}.*")
        return rows.select(bucket_of(key, lo, width).alias("bucket"), F.lit(sign).cast("bigint").alias(ROWS),
                           *[(t.expr.cast("decimal(28,0)") * sign).cast("decimal(28,0)").alias(t.alias) for t in terms])

    both = side(AFTER, 1).unionByName(side(BEFORE, -1))
    return both.groupBy("bucket").agg(F.sum(ROWS).alias(ROWS), *[
        F.coalesce(F.sum(t.alias), F.lit(0)).cast("decimal(38,0)").alias(t.alias) for t in terms])


def keep_checksums(
    changes: DataFrame, path: str, checkpoint: str, key: str, terms: Sequence[Term], lo: int, width: int
) -> StreamingQuery:
    """Add every micro-batch of ``changes`` (structs ``before`` and ``after`` of the table's columns) to the checksums at ``path``.

    Bucket bounds are fixed when the checksums begin; keys outside get buckets below 0 or above the last. Changes may come in any
    order, for sums do not mind.
    """

    def add(rows: DataFrame, batch_id: int) -> None:
        _differences(rows, key, terms, lo, width).coalesce(1).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()


def read_checksums(spark: SparkSession, path: str, terms: Sequence[Term]) -> DataFrame:
    """``bucket`` and ``sums`` (row count and term sums joined by ``|``) as a full scan would give them; emptied buckets have none."""
    total = spark.read.parquet(path).groupBy("bucket").agg(F.sum(ROWS).alias(ROWS), *[F.sum(t.alias).alias(t.alias) for t in terms])
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in (ROWS, *[t.alias for t in terms])])
    kept = reduce(lambda a, b: a | b, [F.col(c) != 0 for c in (ROWS, *[t.alias for t in terms])])
    return total.where(kept).select("bucket", text.alias("sums"))


def fold_checksums(spark: SparkSession, path: str, terms: Sequence[Term]) -> str:
    """A new folder with the batches of ``path`` in one, for when there are very many; replays of folded batches must be over."""
    out = scratch(spark, "checksums")
    total = spark.read.parquet(path).groupBy("bucket").agg(F.sum(ROWS).alias(ROWS), *[F.sum(t.alias).cast("decimal(38,0)").alias(t.alias) for t in terms])
    total.coalesce(1).write.parquet(f"{out}/{BATCH}=-1")
    return out
