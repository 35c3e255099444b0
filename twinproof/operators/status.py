"""Replication status and metric samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.names import VERSION

from .reconcile import SIDE, union_replicas


def replication_status(
    source_log: DataFrame, replicas: Mapping[str, DataFrame], table: str, columns: Sequence[str] = (VERSION,)
) -> DataFrame:
    """Per replica: source position, applied position, their distance, changes not yet applied, rows synced by change
    capture (everything after the snapshot), physical rows (all versions) and the source's row estimate.

    Everything is counts and maxima over the version column alone.
    """
    source = source_log.agg(
        F.max(VERSION).alias("position"), F.count(F.lit(1)).alias("changes"), F.count_if(F.col(VERSION) == 0).alias("rows")
    ).first()
    at, changes, estimate = (F.lit(source[n]).cast("bigint") for n in ("position", "changes", "rows"))
    logs = union_replicas({n: df.select(*columns) for n, df in replicas.items()})
    applied, held = F.max(VERSION).cast("bigint"), F.count(F.lit(1))
    return logs.groupBy(F.col(SIDE).alias("replica")).agg(
        F.lit(table).alias("table"),
        F.max(at).alias("source_position"),
        applied.alias("applied_position"),
        (F.max(at) - applied).alias("lag"),
        (F.max(changes) - held).alias("unapplied"),
        F.count_if(F.col(VERSION) > 0).alias("rows_synced"),
        held.alias("physical_rows"),
        F.max(estimate).alias("source_estimate"),
    )


#: Metric names with the text of their HELP line.
HELP = {
    "mirror_up": "whether the mirror is in state RUNNING (1) or in any other (0)",
    "retained_changes": "largest number of source changes that some replica still lacks",
    "rows_synced": "largest number of change rows found on a replica",
    "table_rows": "rows of a table by store, on replicas with all versions",
    "check_age_seconds": "time since the day check ended",
    "check_ran_ok": "whether the day check came to an end (1) or failed (0)",
    "reconcile_mismatch_days": "settled days on which some replica and the source count differently",
    "reads_total": "reads answered, by mode of the reader",
    "shadow_reads_total": "reads for which both sides were asked",
    "shadow_mismatch_total": "reads whose two answers were not equal",
    "shadow_errors_total": "reads that could not be compared",
    "shadow_latency_seconds_sum": "time that compared reads took, by store",
    "shadow_latency_seconds_count": "compared reads that were timed, by store",
}
_SAMPLE = "array<struct<name:string,labels:map<string,string>,value:double>>"


def _sample(name: str, labels: dict[str, Column], value: Column) -> Column:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v)]
    return F.struct(F.lit(name).alias("name"), F.create_map(*pairs).alias("labels"), value.cast("double").alias("value"))


def _samples(row: DataFrame, *parts: Column) -> DataFrame:
    """The samples of one pass: each row of ``row`` opens into those of all ``parts`` (arrays)."""
    return row.select(F.inline(F.concat(*[p.cast(_SAMPLE) for p in parts])))


def status_metrics(status: DataFrame, mirror: str, state: str) -> DataFrame:
    """Gauges of a mirror as rows ``(name, labels, value)``. The status, a row per replica, is read once."""
    m = {"mirror": F.lit(mirror)}
    whole = status.agg(
        F.max("unapplied").alias("retained"), F.max("rows_synced").alias("synced"),
        F.collect_set(F.struct("table", "source_estimate")).alias("sources"),
        F.collect_list(F.struct("table", "replica", "physical_rows")).alias("stores"),
    )
    return _samples(
        whole,
        F.array(_sample("mirror_up", m, F.lit(1 if state == "RUNNING" else 0)), _sample("retained_changes", m, F.col("retained")),
                _sample("rows_synced", m, F.col("synced"))),
        F.transform("sources", lambda x: _sample("table_rows", {"table": x["table"], "store": F.lit("source")}, x["source_estimate"])),
        F.transform("stores", lambda x: _sample("table_rows", {"table": x["table"], "store": x["replica"]}, x["physical_rows"])),
    )


def check_metrics(summary: DataFrame, mirror: str, age_seconds: float, ran_ok: bool = True) -> DataFrame:
    """Gauges of the last day check. The summary, a row per table, is read once."""
    m = {"mirror": F.lit(mirror)}
    one = summary.agg(F.collect_list(F.struct("table", "bad_day_count")).alias("tables"))
    return _samples(
        one,
        F.array(_sample("check_age_seconds", m, F.lit(float(age_seconds))), _sample("check_ran_ok", m, F.lit(1 if ran_ok else 0))),
        F.transform("tables", lambda x: _sample("reconcile_mismatch_days", {"table": x["table"]}, x["bad_day_count"])),
    )


def shadow_metrics(stats: DataFrame, reads: Mapping[str, int] | None = None, stores: Sequence[str] = ("left", "right")) -> DataFrame:
    """Counters of the shadow reader: its statistics (one row), and ``reads`` by mode where given."""
    none, fine = {"reader": F.lit("shadow")}, F.col("shadowed") - F.col("errors")
    counters = [_sample("shadow_reads_total", none, F.col("shadowed")), _sample("shadow_mismatch_total", none, F.col("mismatches")),
                _sample("shadow_errors_total", none, F.col("errors"))]
    for store, column in zip(stores, ("left_ms", "right_ms")):
        label = {"store": F.lit(store)}
        counters += [_sample("shadow_latency_seconds_sum", label, F.col(column) / 1000), _sample("shadow_latency_seconds_count", label, fine)]
    counters += [_sample("reads_total", {"mode": F.lit(mode)}, F.lit(n)) for mode, n in (reads or {}).items()]
    return _samples(stats, F.array(*counters))


def _escaped(c: Column) -> Column:
    """A label's value as the text format wants it."""
    for mark, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(mark), F.lit(written))
    return c


def _kind(name: Column) -> Column:
    return F.when(name.endswith("_total") | name.endswith("_sum") | name.endswith("_count"), "counter").otherwise("gauge")


def exposition(metrics: DataFrame) -> DataFrame:
    """Text lines of a metrics page, in order: per name HELP and TYPE once, then its samples sorted by labels.

    A name's samples, bounded by its labels, come together once; the head lines open from the same row.
    """
    pairs = F.transform(
        F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))
    )
    v = F.col("value")
    number = F.when((v == F.floor(v)) & (F.abs(v) < F.lit(1e15)), v.cast("bigint").cast("string")).otherwise(v.cast("string"))
    text = F.concat(F.col("name"), F.lit("{"), F.array_join(pairs, ","), F.lit("} "), number)
    helps = F.create_map(*[F.lit(x) for item in HELP.items() for x in item])
    head = F.array(
        F.concat(F.lit("# HELP "), "name", F.lit(" "), F.coalesce(F.try_element_at(helps, F.col("name")), F.lit(""))),
        F.concat(F.lit("# TYPE "), "name", F.lit(" "), _kind(F.col("name"))),
    )
    named = metrics.groupBy("name").agg(F.array_sort(F.collect_list(text)).alias("lines"))
    lines = named.select("name", F.posexplode(F.concat(head, "lines")).alias("at", "line"))
    return lines.select("name", F.least("at", F.lit(2)).alias("rank"), "line").orderBy("name", "rank", "line")
