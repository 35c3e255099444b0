"""Joins and windows over time intervals: overlaps, the next event, bounded existence, cycles, missing ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.clock import ticks
from twinproof.functions.names import FIRST_CYCLE_SECONDS, FAULT_EVERY_SECONDS, FAULT_TOLERANCE_SECONDS
from twinproof.session import pinned

from . import ordered

MICROS = 1_000_000


def _cells(begin: Column, end: Column, width: int) -> Column:
    """Numbers of the time cells an interval touches."""
    return F.sequence(F.floor(begin / width).cast("bigint"), F.floor(end / width).cast("bigint"))


def merge_windows(windows: DataFrame, label: str, w_begin: str, w_end: str, **kw) -> DataFrame:
    """Per label, windows that overlap become one; what overlaps any of them overlaps the merged one and vice versa."""
    # Four passes follow, and windows mostly stand at the end of longer work: written once, read four times.
    w = pinned(windows.select(label, w_begin, w_end).distinct())
    splits = ordered.split_points(w, w_begin, kw.get("chunks"))
    w = ordered.running(w, [label], [w_begin, w_end], "_reach", ticks(w_end), "max", inclusive=False, splits=splits)
    fresh = (F.col("_reach").isNull() | (ticks(w_begin) >= F.col("_reach"))).cast("int")
    w = ordered.running(w, [label], [w_begin, w_end], "_island", fresh, splits=splits)
    return w.groupBy(label, "_island").agg(F.min(w_begin).alias(w_begin), F.max(w_end).alias(w_end)).drop("_island")


def overlap_labels(
    spans: DataFrame,
    windows: DataFrame,
    span_key: Sequence[str],
    begin: str = "beg",
    end: str = "end",
    w_begin: str = "w_beg",
    w_end: str = "w_end",
    label: str = "label",
    cell_seconds: int = 900,
    **kw,
) -> DataFrame:
    """Every span (beg, end] with the sorted distinct labels of the windows that overlap it.

    A window overlaps when it starts before the span ends and ends after the span begins. Windows are first merged
    per label, then both sides are cut into time cells: the join is an equi join on the cell with the exact test
    behind it, so nothing is compared across distant times. Spans without a window keep an empty list.
    """
    width = cell_seconds * MICROS
    cut = spans.select(*span_key, begin, end).withColumn("_cell", F.explode(_cells(ticks(begin), ticks(end), width)))
    faults = merge_windows(windows, label, w_begin, w_end, **kw)
    faults = faults.withColumn("_cell", F.explode(_cells(ticks(w_begin), ticks(w_end), width)))
    pairs = (
        cut.join(faults, "_cell")
        .where((F.col(w_begin) < F.col(end)) & (F.col(w_end) > F.col(begin)))
        .select(*span_key, label)
        .distinct()
    )
    hits = pairs.groupBy(*span_key).agg(F.array_sort(F.collect_set(label)).alias("labels"))
    none = F.array().cast("array<string>")
    return spans.join(hits, list(span_key), "left").withColumn("labels", F.coalesce("labels", none))


def next_after(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: Column, name: str, value: str | None = None, **kw
) -> DataFrame:
    """For each row the ``value`` (by default the time) of the next row of its key that satisfies ``wanted`` and is later:
    rows of the same time do not count, in whatever order they lie."""
    value = value or order[0]
    return ordered.carry(
        events, keys, order, {name: F.when(wanted, F.col(value))}, inclusive=False, forward=False, strict=True, **kw
    )


def exists_within(
    actions: DataFrame,
    log: DataFrame,
    keys: Sequence[str],
    at: str,
    log_at: str,
    low: Column,
    high: Column,
    action_key: Sequence[str],
    kind: str,
    log_kind: str,
    cell_seconds: int = 300,
) -> DataFrame:
    """``actions`` plus ``verified``: is there a log event of the wanted kind in [at + low, at + high] seconds?

    Repeated log events collapse before the join (existence needs no duplicates), which runs per (key, kind, time
    cell) as a semi join: it never emits pairs.
    """
    width = cell_seconds * MICROS
    marks = log.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(log_kind).alias("_kind"), ticks(log_at).alias("_t")
    ).distinct()
    marks = marks.withColumn("_cell", F.floor(F.col("_t") / width).cast("bigint"))
    probes = actions.select(
        *action_key,
        *[F.col(k) for k in keys if k not in action_key],
        F.col(kind).alias("_want"),
        (ticks(at) + low * MICROS).alias("_low"),
        (ticks(at) + high * MICROS).alias("_high"),
    ).withColumn("_cell", F.explode(_cells(F.col("_low"), F.col("_high"), width)))
    cond = (probes["_cell"] == marks["_cell"]) & (F.col("_want") == F.col("_kind"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    cond = cond & (F.col("_t") >= F.col("_low")) & (F.col("_t") <= F.col("_high"))
    found = probes.join(marks, cond, "left_semi").select(*action_key).distinct().withColumn("verified", F.lit(True))
    return actions.join(found, list(action_key), "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def cycle_intervals(checks: DataFrame, cycle: str = "cycle", ts: str = "ts", **kw) -> DataFrame:
    """One row per cycle: (previous cycle's last check, this cycle's last check]; the first begins 15 minutes early."""
    cycles = checks.groupBy(cycle).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("end"))
    return link_cycles(cycles, cycle, **kw).select(cycle, "beg", "end")


def link_cycles(cycles: DataFrame, cycle: str = "cycle", **kw) -> DataFrame:
    """``cycles`` with the begin of each: the end of the cycle before, in the order of their first check."""
    linked = ordered.previous(cycles, [], ["first_seen", cycle], {"_before": "end"}, **kw)
    start = F.coalesce(F.col("_before"), F.col("end") - F.expr(f"INTERVAL {FIRST_CYCLE_SECONDS} SECONDS"))
    return linked.select(*cycles.columns, start.alias("beg"))


def schedule_gaps(
    faults: DataFrame,
    start: Column,
    last_check: Column,
    every: int = FAULT_EVERY_SECONDS,
    tolerance: int = FAULT_TOLERANCE_SECONDS,
    **kw,
) -> DataFrame:
    """Per gap between faults: the number of scheduled faults that never happened, and whether the closing fault was due.

    ``faults`` has ``t`` (seconds, bigint) and ``done`` (seconds at which that fault ended). The schedule counts
    ``every`` seconds from the end of the fault before (from ``start`` for the first). One more gap reaches from the
    last fault to the last check. ``start`` and ``last_check`` are seconds, as columns without input rows.
    """
    rows = faults.select(F.col("t").cast("bigint").alias("t"), F.col("done").cast("bigint").alias("done"))
    linked = ordered.previous(rows, [], ["t", "done"], {"_before": "done"}, **kw)
    gaps = linked.select(F.coalesce("_before", start).alias("begin"), F.col("t"), F.col("done"))
    tail = rows.agg(F.max_by("done", F.struct("t", "done")).alias("begin")).select(
        F.coalesce("begin", start).alias("begin"), F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("bigint").alias("done")
    )
    gaps = gaps.unionByName(tail)
    # Ticks begin + k * every (k = 1, 2, ...) are missing while they lie at or before the last check and more than
    # ``tolerance`` seconds before the fault that closes the gap.
    by_check = F.floor((last_check - F.col("begin")) / F.lit(every))
    by_fault = F.ceil((F.col("t") - F.lit(tolerance) - F.col("begin")) / F.lit(every)) - 1
    missing = F.greatest(F.least(by_check, F.coalesce(by_fault, by_check)), F.lit(0)).cast("bigint")
    due = F.col("begin") + (missing + 1) * F.lit(every)
    return gaps.select(
        "begin", "t", "done",
        missing.alias("missing"),
        (F.col("t").isNotNull() & (due <= last_check)).alias("closing_fault_due"),
    )


def missing_ticks(gaps: DataFrame, every: int = FAULT_EVERY_SECONDS) -> DataFrame:
    """The due times (seconds) of the scheduled faults that never happened."""
    k = F.explode(F.expr("sequence(1L, missing)")).alias("k")
    return gaps.where(F.col("missing") > 0).select("begin", k).select(
        (F.col("begin") + F.col("k") * F.lit(every)).alias("due")
    )
