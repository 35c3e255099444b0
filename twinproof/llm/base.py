"""Helpers of the corpus operators: reading tables, durable intermediates, fixed-size hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.session import scratch

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs no more than its running tasks."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: one without belongs to the cluster's default file system, which workers cannot tell by themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def dealt(df: DataFrame, *by) -> DataFrame:
    """Deal rows evenly over the session's shuffle partitions, so that one large input file is not one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by)


def lower_ascii(col):
    return F.translate(col, _UPPER, _LOWER)


def words(col):
    """The words of a text, NULL and empty texts having none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches as smaller ones, so that what a worker makes of a batch at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a seed."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x) | np.uint64(1)


def joined_by_salt(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """``left`` with the columns of ``right``, a row per value of ``keys`` at most: rows of a common key meet copies of its row in many tasks.

    Rows of ``left`` without a partner go; NULL keys meet nothing. ``right`` is repeated ``salts`` times.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    deal = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    return left.withColumn("_salt", deal).join(spread, [*keys, "_salt"]).drop("_salt")


def joined_by_share(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str, shares: int = 4096, salts: int = 64) -> DataFrame:
    """``left`` joined with ``right``, rows of a common key in many tasks.

    ``counts`` holds ``keys`` and ``times``, the rows of ``left`` of each key (those of rare keys may be missing). Of keys that own more than
    one in ``shares`` of these rows there are fewer than ``shares``, whatever the size: their list is broadcast, their rows on the left are
    dealt over ``salts``, and those on the right are repeated for each. NULL keys meet nothing.
    """
    total = counts.agg(F.sum("times")).first()[0] or 0
    common = F.broadcast(counts.filter(F.col("times") * shares > total).select(*keys, F.lit(True).alias("_common")))
    deal = F.when(F.col("_common"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("_common"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(common, keys, "left").withColumn("_salt", deal).drop("_common")
    b = right.join(common, keys, "left").withColumn("_salt", F.explode(copies)).drop("_common")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
