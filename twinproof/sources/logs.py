"""Run logs as DataFrames: check records, fault actions, server events, host ticks, core use, claims, bench documents.

Every reader takes lines (a DataFrame with a ``value`` column, from ``spark.read.text`` or a stream) or a path; lines
that do not have the expected shape are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_FIELDS = [
    ("ts", T.TimestampType()), ("cycle", T.IntegerType()), ("variant", T.StringType()), ("replica", T.StringType()),
    ("table", T.StringType()), ("pg", T.StringType()), ("ch", T.StringType()), ("match", T.BooleanType()),
    ("waited_s", T.IntegerType()), ("err", T.StringType()),
]
CHECKS = T.StructType([T.StructField(name, kind) for name, kind in _FIELDS])
_BAD = "_malformed"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


# --- check records ---------------------------------------------------------------------------------------------

def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Check records from JSON lines; malformed lines are dropped, whichever columns are read later."""
    return parse_checks(lines(spark, path))


def parse_checks(text: DataFrame) -> DataFrame:
    """The same records from text lines already at hand."""
    with_bad = T.StructType([*CHECKS.fields, T.StructField(_BAD, T.StringType())])
    parsed = text.select(F.from_json("value", with_bad, {"columnNameOfCorruptRecord": _BAD}).alias("c")).where(
        F.col(f"c.{_BAD}").isNull() & F.col("c.cycle").isNotNull() & F.col("c.match").isNotNull())
    return parsed.select(*[F.col("c").getField(f.name).alias(f.name) for f in CHECKS.fields])


def append_checks(checks: DataFrame, path: str) -> None:
    checks.write.mode("append").json(path)


# --- regular-expression lines ------------------------------------------------------------------------------------

# The line formats of the injector, the server messages and the monitor, as they stand in the logs.
_FAULT = r"^(\S+) (restart|stop|start) ([a-z0-9-]+) \("
_START = r"^(\S+) chaos start, until epoch (\d+)"
_SKIP = r"SKIP|skip fault|FATAL"
_STOPPED = (
    r"Received termination signal|database system is shut down|received fast shutdown request|"
    r"received smart shutdown request"
)
_UP = r"Starting ClickHouse|Starting server|\"Started Worker\"|database system is ready to accept connections"
_STAMP = r"(\d{4}[-.]\d\d[-.]\d\d[T ]\d\d:\d\d:\d\d)"
_TICK = (
    r"^(\S+ \S+) [A-Z]{2,5} tick load=([\d.]+) .*?agent_cpu_psi_avg10=([\d.]+) nr_throttled=(\d+) throttled_usec=(\d+)"
)
_CORES = r"\bcpu\d+=(\d+)%"


def _second(c: Column) -> Column:
    """Time of the first 19 characters (``2026-10-05T17:32:09``), as UTC without zone."""
    return F.try_to_timestamp(F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def parse_faults(text: DataFrame) -> DataFrame:
    """Fault actions ``(ts, action, service)``."""
    part = lambda i: F.regexp_extract("value", _FAULT, i)
    return text.where(F.col("value").rlike(_FAULT)).select(
        _second(part(1)).alias("ts"), part(2).alias("action"), part(3).alias("service")
    )


def parse_run_bounds(text: DataFrame) -> DataFrame:
    """``(start, until)`` of the fault injector."""
    part = lambda i: F.regexp_extract("value", _START, i)
    return text.where(F.col("value").rlike(_START)).select(
        _second(part(1)).alias("start"), F.timestamp_seconds(part(2).cast("bigint")).cast("timestamp_ntz").alias("until")
    )


def parse_skips(text: DataFrame) -> DataFrame:
    """Lines that record a fault not carried out."""
    rest = F.regexp_replace("value", r"^\S+ ", "")
    other = ~F.col("value").rlike(_FAULT) & ~F.col("value").rlike(_START)
    return text.where(other & rest.rlike(_SKIP)).select(_second(F.col("value")).alias("ts"), F.col("value").alias("line"))


def parse_fault_counts(text: DataFrame) -> DataFrame:
    """``(ts, act)`` with the two words after the time, for counting: skips, injector lines and keeper starts left out."""
    words = F.split("value", r"\s+")
    act = F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(2)))
    rows = text.select(_second(F.get(words, F.lit(0))).alias("ts"), act.alias("act"))
    return rows.where(F.col("ts").isNotNull() & ~F.col("act").rlike(r"^(skip|start keeper|chaos)"))


def parse_server_log(text: DataFrame, service: str | Column = "service") -> DataFrame:
    """Boot and shutdown events ``(service, ts, kind)`` of server logs; ``kind`` is ``up`` or ``stop``."""
    svc = F.col(service) if isinstance(service, str) else service
    stamp = F.regexp_extract("value", _STAMP, 1)
    at = F.try_to_timestamp(F.translate(stamp, ".T", "- "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    kind = F.when(F.col("value").rlike(_STOPPED), "stop").when(F.col("value").rlike(_UP), "up")
    return text.select(svc.alias("service"), at.alias("ts"), kind.alias("kind")).where("ts is not null and kind is not null")


def parse_ticks(text: DataFrame, utc_offset_hours: int = 2) -> DataFrame:
    """Host ticks ``(ts, load, pressure, throttled_usec)``; local time, ``utc_offset_hours`` ahead of UTC, becomes UTC."""
    part = lambda i: F.regexp_extract("value", _TICK, i)
    return text.where(F.col("value").rlike(_TICK)).select(
        (_second(part(1)) - F.expr(f"INTERVAL {utc_offset_hours} HOURS")).alias("ts"),
        part(2).cast("double").alias("load"),
        part(3).cast("double").alias("pressure"),
        part(5).cast("bigint").alias("throttled_usec"),
    )


def parse_core_use(text: DataFrame) -> DataFrame:
    """Mean use of the cores that a line names, per minute: ``(ts, busy)``."""
    cores = F.transform(F.regexp_extract_all("value", F.lit(_CORES), F.lit(1)), lambda x: x.cast("double"))
    busy = F.aggregate(cores, F.lit(0.0), lambda a, x: a + x) / F.size(cores)
    return text.where(F.col("value").rlike(_CORES)).select(_second(F.split("value", " ")[0]).alias("ts"), busy.alias("busy"))


# --- claims and bench documents ----------------------------------------------------------------------------------

def parse_claims(text: DataFrame) -> DataFrame:
    """Claims ``(claim, log, patterns)`` from tab-separated lines; blank lines and ``#`` comments are left out."""
    rows = text.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    return rows.where(F.size(parts) == 3).select(
        F.get(parts, F.lit(0)).alias("claim"),
        F.get(parts, F.lit(1)).alias("log"),
        F.split(F.get(parts, F.lit(2)), " && ").alias("patterns"),
    )


def read_bench_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per query of a nested bench document, whatever stores it holds."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def parse_bench_documents(text: DataFrame) -> DataFrame:
    """``(query, store, run, ms)`` samples and ``result_rows`` from JSON documents held one per line."""
    schema = (
        "struct<results: array<struct<query: string, runs: map<string, array<double>>, result_rows: map<string, bigint>>>>"
    )
    return text.select(F.explode(F.from_json("value", schema)["results"]).alias("r")).select("r.*")


def bench_samples(results: DataFrame, suffix: str = "_runs_ms") -> DataFrame:
    """Samples in long form from either layout: a ``runs`` map, or one ``<store>_runs_ms`` array per store."""
    if "runs" in results.columns:
        stores = results.select("query", F.explode("runs").alias("store", "values"))
    else:
        names = [c for c in results.columns if c.endswith(suffix)]
        pairs = [F.struct(F.lit(n[: -len(suffix)]).alias("store"), F.col(n).cast("array<double>").alias("values")) for n in names]
        stores = results.select("query", F.inline(F.array(*pairs)))
    return stores.select("query", "store", F.posexplode("values").alias("run", "ms"))
