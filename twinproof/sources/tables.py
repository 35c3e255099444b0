"""Table sources and sinks: scans, snapshot copies, version logs on storage, Parquet copies, tab-separated results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinproof.functions.clock import month_key, ntz
from twinproof.functions.names import DELETED, SNAPSHOT_PARTITION_ROWS, SYNCED, VERSION

MONTH = "ym"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    low: int,
    high: int,
    rows: int,
    properties: dict[str, str] | None = None,
    partition_rows: int = SNAPSHOT_PARTITION_ROWS,
) -> DataFrame:
    """A relational source in key ranges of about ``partition_rows`` rows; Spark pushes filters and columns down."""
    parts = max(1, -(-rows // partition_rows))
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high + 1, numPartitions=parts, properties=properties or {}
    )


def snapshot(table: DataFrame, synced_at: str | None = None) -> DataFrame:
    """Every row as version 0 of a version log."""
    out = table.withColumns({VERSION: F.lit(0).cast("bigint"), DELETED: F.lit(False)})
    return out.withColumn(SYNCED, ntz(synced_at)) if synced_at else out


def copy_snapshot(
    table: DataFrame, key: str, path: str, partition_rows: int = SNAPSHOT_PARTITION_ROWS, cluster: bool = False
) -> DataFrame:
    """Copy a table into a new version log at ``path`` and return the log.

    A table of files is copied split by split, without a shuffle. ``cluster`` range-partitions by key first, in ranges
    of about ``partition_rows`` rows, so that files cover narrow key ranges. A path that exists is refused: a copy that is
    run again must not double version 0.
    """
    rows = snapshot(table)
    if cluster:
        parts = max(1, -(-table.count() // partition_rows))
        rows = rows.repartitionByRange(parts, key).sortWithinPartitions(key)
    rows.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)


def copy_in_ranges(
    table: DataFrame, key: str, path: str, partition_rows: int = SNAPSHOT_PARTITION_ROWS, ranges: int = 64, before_range=None
) -> DataFrame:
    """Copy a table range by range of a numeric key; a copy that broke off goes on where it stopped.

    The ranges are decided once and written beside the copy; a range is one job, whose filter reaches the source, and its folder counts as
    copied once Spark has committed it. A rerun copies the other ranges only, over what they left half-written. Rows that the source gets after the first
    run began and that lie in copied ranges are the change feed's. NULL keys have a range of their own; ``before_range(n)`` is called before
    each copied one. There are at most ``ranges`` ranges, whatever the table's size, each written by as many tasks as ``partition_rows`` asks for.
    """
    spark, path = table.sparkSession, path.rstrip("/")
    if not exists(spark, f"{path}/_ranges/_SUCCESS"):
        bounds = table.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
            key, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts") if ranges > 1 else F.array().alias("cuts")).first()
        cuts = sorted(set(bounds["cuts"] or []))
        plan = spark.createDataFrame([(bounds["n"], [str(c) for c in cuts])], "rows bigint, cuts array<string>")
        plan.coalesce(1).write.mode("overwrite").json(f"{path}/_ranges")
    plan = spark.read.schema("rows bigint, cuts array<string>").json(f"{path}/_ranges").first()
    kind, k = table.schema[key].dataType, F.col(key)
    cuts = [F.lit(c).cast(kind) for c in plan["cuts"]]
    tasks = max(1, -(-plan["rows"] // (partition_rows * (len(cuts) + 1))))
    for n in range(-1, len(cuts) + 1):
        target = f"{path}/range-{n}"
        if exists(spark, f"{target}/_SUCCESS"):
            continue
        if before_range:
            before_range(n)
        if n < 0:
            inside = k.isNull()
        else:
            low, high = cuts[n - 1] if n else None, cuts[n] if n < len(cuts) else None
            bound = [c for c in (k >= low if low is not None else None, k < high if high is not None else None) if c is not None]
            inside = bound[0] & bound[1] if len(bound) == 2 else bound[0] if bound else k.isNotNull()
        rows = snapshot(table.where(inside))
        (rows.repartition(tasks) if tasks > 1 else rows.coalesce(1)).write.mode("overwrite").parquet(target)
    log = snapshot(table).schema
    return spark.read.schema(log).parquet(*[f"{path}/range-{n}" for n in range(-1, len(cuts) + 1)])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path`` on the file system it belongs to."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(name)


def write_version_log(log: DataFrame, path: str, order_by: Sequence[str], time_column: str | None, mode: str = "append") -> None:
    """Store a version log partitioned by month and sorted by its sort key within each file.

    Month and leading sort key range-partition the rows, so a large month is written by many tasks and every file
    covers a narrow stretch of the key: scans skip by partition, then by row-group minima and maxima.
    """
    if time_column is None:
        log.repartitionByRange(*order_by).sortWithinPartitions(*order_by).write.mode(mode).parquet(path)
        return
    rows = log.withColumn(MONTH, month_key(time_column))
    spread = rows.repartitionByRange(MONTH, *order_by).sortWithinPartitions(MONTH, *order_by)
    spread.write.mode(mode).partitionBy(MONTH).parquet(path)


def read_version_log(
    spark: SparkSession, path: str, time_column: str | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """A stored version log; bounds on the time column also become bounds on the month folder.

    Only bound a log whose time column is part of its sort key (or never changes): the fold must see all versions of
    a key.
    """
    log = spark.read.option("recursiveFileLookup", "false").parquet(path)
    if MONTH in log.columns:
        log = log.withColumn(MONTH, F.col(MONTH).cast("string"))
    if time_column and since:
        log = log.where((F.col(time_column) >= ntz(since)) & (F.col(MONTH) >= since[:4] + since[5:7]))
    if time_column and until:
        log = log.where((F.col(time_column) < ntz(until)) & (F.col(MONTH) <= until[:4] + until[5:7]))
    return log.drop(MONTH)


def save_bucketed_log(log: DataFrame, table: str, path: str, order_by: Sequence[str], buckets: int) -> None:
    """Store a version log bucketed by its sort key: every later fold on that key runs without a shuffle."""
    writer = log.repartition(buckets, *order_by).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *order_by).sortBy(*order_by).saveAsTable(table)


def copy_parquet(table: DataFrame, path: str) -> DataFrame:
    """Copy a whole table to Parquet and return the copy."""
    table.write.mode("errorifexists").parquet(path)
    return table.sparkSession.read.parquet(path)


def read_tab_separated(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``key<TAB>value...`` result lines. Lines without a tab are skipped; a bad number fails the read."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.col("value").contains("\t"))
    parts = F.split("value", "\t")
    # Casting under ANSI rules raises on text that is not a number.
    return lines.select(*[F.get(parts, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields.fields)])


def write_tab_separated(df: DataFrame, path: str) -> None:
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]
    df.select(F.concat_ws("\t", *cols).alias("value")).write.mode("errorifexists").text(path)
