"""Session settings and the shared folder for written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "twinproof", master: str | None = None, cpus: int | None = None) -> SparkSession:
    """Build (or get) a session with the settings every operator assumes."""
    # Checkpoints go as soon as nothing refers to them any more.
    builder = SparkSession.builder.appName(name).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master or cpus:
        builder = builder.master(master or f"local[{cpus}]")
    if cpus:
        builder = builder.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        # Only a JVM that is still to be started takes the memory setting.
        builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (UTC) and the adaptive re-planning that large runs rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for written intermediates; a private one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="twinproof-")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{shared_dir(spark)}/twinproof/{label}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that every later pass sees the same rows in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
