"""Verdicts over long runs with injected faults: clean and affected cycles, misses, recovery, criteria."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.clock import ntz
from twinproof.functions.names import (
    FIRST_CYCLE_SECONDS, MAX_P99_SECONDS, MIN_HOURS, OUTAGE_DEFAULT_SECONDS, RESTART_GRACE_SECONDS,
)
from twinproof.operators.intervals import link_cycles, next_after, overlap_labels
from twinproof.operators.onerow import side_by_side
from twinproof.operators.ordered import order_statistics, rank_below, rank_floor, rank_last, rank_upper_median
from twinproof.session import pinned

from .cycles import insert_rate, miss_class, miss_recovery, per_cycle, recovery_of

def _seconds(n: int) -> Column:
    return F.expr(f"INTERVAL {n} SECONDS")


def outage_ends(faults: DataFrame, **kw) -> DataFrame:
    """Fault actions with ``next_start``: the next start of the same service."""
    return next_after(faults, ["service"], ["ts"], F.col("action") == "start", "next_start", **kw)


def fault_windows(faults: DataFrame, **kw) -> DataFrame:
    """``(w_beg, w_end, label)``: a restart counts for two minutes; an outage from its stop to its start plus two
    minutes, with ten minutes assumed where no start was logged."""
    linked = outage_ends(faults, **kw)
    grace = _seconds(RESTART_GRACE_SECONDS)
    back = F.coalesce(F.col("next_start"), F.col("ts") + _seconds(OUTAGE_DEFAULT_SECONDS))
    stop = F.col("action") == "stop"
    return linked.where(F.col("action").isin("restart", "stop")).select(
        F.col("ts").alias("w_beg"),
        F.when(stop, back + grace).otherwise(F.col("ts") + grace).alias("w_end"),
        F.concat(F.when(stop, "outage ").otherwise("restart "), F.col("service")).alias("label"),
    )


def grade(cycles: DataFrame, faults: DataFrame, **kw) -> DataFrame:
    """Rows of ``per_cycle`` with their interval, the labels of overlapping faults, and ``clean``."""
    spans = overlap_labels(link_cycles(cycles, **kw), fault_windows(faults, **kw), ["cycle"], **kw)
    return spans.withColumn("clean", F.size("labels") == 0)


def graded_cycles(checks: DataFrame, faults: DataFrame, **kw) -> DataFrame:
    return grade(per_cycle(checks), faults, **kw)


def clean_waits(checks: DataFrame, cycles: DataFrame, **kw) -> DataFrame:
    """p50, p99 and maximum of the waits of matched checks in clean cycles.

    Waits are counted per cycle and value before they meet the cycles, so a cycle with very many checks stays small.
    """
    counted = pinned(checks.where("match").groupBy("cycle", "waited_s").agg(F.count(F.lit(1)).alias("n")))
    clean = counted.join(cycles.where("clean").select("cycle"), "cycle", "left_semi").drop("cycle")
    return wait_statistics(clean, [], weight="n", **kw)


def wait_statistics(waits: DataFrame, by: Sequence[str], weight: str | None = None, **kw) -> DataFrame:
    ranks = {"p50": rank_upper_median(), "p99": rank_below(0.99), "max": rank_last()}
    return order_statistics(waits, by, "waited_s", ranks, weight=weight, **kw)


def host_throttle(ticks: DataFrame, first: Column, last: Column) -> DataFrame:
    """Host conditions inside the run: throttled seconds (last minus first counter), span, share of wall time, load and pressure."""
    inside = ticks.where((F.col("ts") >= first - _seconds(FIRST_CYCLE_SECONDS)) & (F.col("ts") <= last))
    place = F.struct("ts", "throttled_usec")
    out = inside.agg(
        F.count(F.lit(1)).alias("ticks"),
        ((F.max_by("throttled_usec", place) - F.min_by("throttled_usec", place)) / F.lit(1e6)).alias("throttled_s"),
        (F.max("ts").cast("timestamp").cast("bigint") - F.min("ts").cast("timestamp").cast("bigint")).alias("span_s"),
        F.max("load").alias("load_max"),
        F.max("pressure").alias("pressure_max"),
    )
    middle = [
        order_statistics(inside, [], column, {f"{column}_p50": rank_upper_median()}).select(f"{column}_p50") for column in ("load", "pressure")
    ]
    out = side_by_side(out, *middle)
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("throttled_s"), F.col("span_s")), F.lit(0.0)))


@dataclass(frozen=True)
class SoakVerdict:
    cycles: DataFrame
    recovery: DataFrame
    stats: DataFrame
    criteria: DataFrame


def _hours(first: Column, last: Column) -> Column:
    return (last.cast("timestamp").cast("bigint") - first.cast("timestamp").cast("bigint")) / F.lit(3600.0)


def _stats(checks: DataFrame, cycles: DataFrame, recovery: DataFrame, **kw) -> DataFrame:
    totals = cycles.agg(
        *[F.sum(c).alias(c) for c in ("checks", "exact", "lag_misses", "query_errors", "memory_errors")],
        _hours(F.min("first_seen"), F.max("end")).alias("hours"),
        F.min("first_seen").alias("first"),
        F.max("end").alias("last"),
        F.count(F.lit(1)).alias("cycles"),
        F.count_if("clean").alias("clean"),
        F.count_if(~F.col("clean")).alias("affected"),
        F.count_if(F.col("clean") & F.col("missed")).alias("clean_misses"),
        (~F.max_by("missed", "end")).alias("final_exact"),
    )
    recovered = recovery.agg(
        F.count_if(F.col("recovered").isNull()).alias("pending"),
        F.count_if(F.col("recovered") == F.lit(False)).alias("unrecovered"),
    )
    return side_by_side(totals, recovered, clean_waits(checks, cycles, **kw).drop("n"))


def _criterion(order: int, name: str, ok: Column, got: Column) -> Column:
    return F.struct(
        F.lit(order).alias("no"), F.lit(name).alias("criterion"), F.coalesce(ok, F.lit(False)).alias("ok"),
        got.cast("string").alias("got"),
    )


def _criteria(stats: DataFrame, rows: Sequence[Column]) -> DataFrame:
    listed = stats.select(F.inline(F.array(*rows)))
    call = listed.agg(F.every("ok").alias("ok")).select(
        F.lit(99).alias("no"), F.lit("call").alias("criterion"), "ok", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("got")
    )
    return listed.unionByName(call).orderBy("no")


def soak_verdict(
    checks: DataFrame,
    faults: DataFrame,
    audit_ok: bool | DataFrame = True,
    valid: bool = True,
    pending_fails: bool = True,
    **kw,
) -> SoakVerdict:
    """The eight criteria of a single-layout fault run, and the call.

    ``audit_ok`` is a flag or the one-row summary of ``audit.fault_audit``. ``pending_fails``: a miss in the last
    cycle, whose next cycle was never checked, fails here; the tally calls it pending instead.
    """
    # Cycles and faults are small next to the checks; each is written once and then read by every part.
    cycles = pinned(grade(pinned(per_cycle(checks)), pinned(faults), **kw))
    recovery = recovery_of(cycles)
    stats = _stats(checks, cycles, recovery, **kw)
    if isinstance(audit_ok, DataFrame):
        stats = side_by_side(stats, audit_ok.select(F.col("ok").alias("audit_ok")))
    else:
        stats = stats.withColumn("audit_ok", F.lit(audit_ok))
    c = F.col
    recovered = (c("unrecovered") == 0) & ((c("pending") == 0) if pending_fails else F.lit(True))
    rows = [
        _criterion(1, "run valid", F.lit(valid), F.lit(valid)),
        _criterion(2, "every scheduled fault applied and verified, none skipped", c("audit_ok"), c("audit_ok")),
        _criterion(3, f"duration >= {MIN_HOURS} h", c("hours") >= MIN_HOURS, F.round("hours", 1)),
        _criterion(4, "every cycle with a mismatch is followed by an exact cycle", recovered, c("unrecovered") + c("pending")),
        _criterion(5, "the final cycle is exact", c("final_exact"), c("final_exact")),
        _criterion(6, "0 misses in clean cycles", c("clean_misses") == 0, c("clean_misses")),
        _criterion(7, f"clean-cycle p99 catch-up <= {MAX_P99_SECONDS} s", c("p99") <= MAX_P99_SECONDS, c("p99")),
        _criterion(8, "0 memory errors", c("memory_errors") == 0, c("memory_errors")),
    ]
    return SoakVerdict(cycles, recovery, stats, _criteria(stats, rows))


# --- tally over several layouts -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Windows:
    """Excluded and contended stretches of a run, as half-open [from, to) pairs of UTC times."""

    excluded: Sequence[tuple[str, str]] = ()
    contention: Sequence[tuple[str, str]] = ()

    def label(self, ts: str = "ts") -> Column:
        """``excluded``, ``contention`` or ``valid``."""
        t = F.col(ts).cast("timestamp_ntz")
        inside = lambda spans: [(t >= ntz(a)) & (t < ntz(b)) for a, b in spans]
        out = F.lit("valid")
        for hit in inside(self.contention):
            out = F.when(hit, "contention").otherwise(out)
        for hit in inside(self.excluded):
            out = F.when(hit, "excluded").otherwise(out)
        return out


def tally_by_window(checks: DataFrame, windows: Windows) -> DataFrame:
    """Counters per (window, variant) under dynamic keys: checks, lag_miss, query_error, miss_cycles_<n>."""
    rows = checks.select(
        windows.label().alias("window"),
        "variant",
        F.filter(
            F.array(
                F.lit("checks"),
                F.when(miss_class() == "lag", "lag_miss").when(miss_class().isin("error", "memory"), "query_error"),
                F.when(~F.col("match"), F.concat(F.lit("miss_cycles_"), F.col("cycle").cast("string"))),
            ),
            lambda k: k.isNotNull(),
        ).alias("ks"),
    )
    return rows.select("window", "variant", F.explode("ks").alias("counter")).groupBy("window", "variant", "counter").agg(
        F.count(F.lit(1)).alias("n")
    )


def contention_cycles(checks: DataFrame, windows: Windows) -> DataFrame:
    """Cycles inside contention: first check, checks, misses, longest wait."""
    inside = checks.where(windows.label() == "contention")
    return inside.groupBy("cycle").agg(
        F.min("ts").cast("timestamp_ntz").alias("first"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("match")).alias("misses"),
        F.max("waited_s").alias("max_wait"),
    )


def valid_hours(checks: DataFrame, run_start: str, windows: Windows) -> DataFrame:
    """Hours of the run without the excluded stretches, and hours of contention clipped to the run."""
    end = F.max("ts").cast("timestamp").cast("bigint")
    at = lambda s: F.lit(s).cast("timestamp").cast("bigint")

    def clipped(spans) -> Column:
        total = F.lit(0)
        for a, b in spans:
            total = total + F.greatest(F.least(F.col("_end"), at(b)) - F.greatest(at(run_start), at(a)), F.lit(0))
        return total

    one = checks.agg(end.alias("_end"))
    whole = F.col("_end") - at(run_start)
    return one.select(
        ((whole - clipped(windows.excluded)) / 3600.0).alias("valid_hours"),
        (clipped(windows.contention) / 3600.0).alias("contention_hours"),
    )


def integrity(recovery: DataFrame) -> DataFrame:
    """``FAIL`` if a miss did not recover, ``PENDING`` if one has no next cycle yet, else ``PASS``."""
    out = recovery.agg(
        F.count_if(F.col("recovered") == F.lit(False)).alias("failed"), F.count_if(F.col("recovered").isNull()).alias("pending")
    )
    return out.withColumn(
        "integrity", F.when(F.col("failed") > 0, "FAIL").when(F.col("pending") > 0, "PENDING").otherwise("PASS")
    )


def fault_counts(acts: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """Faults survived, per action and service (from ``logs.parse_fault_counts``), outside excluded stretches."""
    return acts.where(windows.label() != "excluded").groupBy("act").agg(F.count(F.lit(1)).alias("n"))


def busy_cores(use: DataFrame, windows: Windows = Windows(), **kw) -> DataFrame:
    """Mean and p90 of core use in valid time without contention."""
    inside = use.where(windows.label() == "valid")
    p90 = order_statistics(inside, [], "busy", {"p90": rank_floor(0.9)}, **kw)
    return side_by_side(inside.agg(F.avg("busy").alias("mean")), p90).select("n", "mean", "p90")


@dataclass(frozen=True)
class SoakTally:
    counters: DataFrame
    contention: DataFrame
    hours: DataFrame
    layouts: DataFrame
    recovery: DataFrame
    integrity: DataFrame
    faults: DataFrame
    waits: DataFrame
    busy: DataFrame
    rate: DataFrame
    cycles: DataFrame


def soak_tally(
    checks: DataFrame, acts: DataFrame, use: DataFrame, run_start: str, windows: Windows, layout: str, rate_table: str = "events", **kw
) -> SoakTally:
    """All figures of a run over several layouts; ``layout`` is the one the sizing figures are for."""
    valid = checks.where(windows.label() != "excluded")
    kind = miss_class()
    layouts = valid.groupBy("variant").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if("match").alias("exact"),
        F.count_if(kind == "lag").alias("lag_misses"),
        F.count_if(kind.isin("error", "memory")).alias("query_errors"),
    )
    misses = miss_recovery(checks).join(
        valid.where(~F.col("match")).select("cycle").distinct(), "cycle", "left_semi"
    )
    mine = valid.where(F.col("variant") == layout)
    per_cycle = mine.groupBy("cycle").agg(F.some(~F.col("match")).alias("missed"))
    return SoakTally(
        counters=tally_by_window(checks, windows),
        contention=contention_cycles(checks, windows),
        hours=valid_hours(checks, run_start, windows),
        layouts=layouts,
        recovery=misses,
        integrity=integrity(misses),
        faults=fault_counts(acts, windows),
        waits=wait_statistics(mine.where("match"), [], **kw),
        busy=busy_cores(use, windows, **kw),
        rate=insert_rate(checks.where((F.col("table") == rate_table) & (F.col("variant") == layout))),
        cycles=per_cycle.agg(F.count(F.lit(1)).alias("cycles"), F.count_if("missed").alias("missed")),
    )


@dataclass(frozen=True)
class ConfirmTally:
    stats: DataFrame
    recovery: DataFrame
    faults: DataFrame
    criteria: DataFrame


def confirm_tally(checks: DataFrame, acts: DataFrame, rate_table: str = "events", **kw) -> ConfirmTally:
    """The tally of a one-layout run with its five criteria."""
    cycles = pinned(per_cycle(checks))
    recovery = recovery_of(cycles)
    totals = cycles.agg(
        F.count(F.lit(1)).alias("cycles"),
        *[F.sum(c).alias(c) for c in ("checks", "exact", "lag_misses", "query_errors")],
        _hours(F.min("first_seen"), F.max("end")).alias("hours"),
    )
    waits = wait_statistics(checks.where("match"), [], **kw).drop("n")
    rate = insert_rate(checks.where(F.col("table") == rate_table)).select("rate")
    stats = side_by_side(totals, waits, rate, integrity(recovery).select("integrity"))
    c = F.col
    rows = [
        _criterion(1, "every miss followed by an exact cycle", c("integrity") == "PASS", c("integrity")),
        _criterion(2, f"duration >= {MIN_HOURS} h", F.round("hours", 1) >= MIN_HOURS, F.round("hours", 1)),
        _criterion(3, "0 freshness misses", c("lag_misses") == 0, c("lag_misses")),
        _criterion(4, f"p99 catch-up wait <= {MAX_P99_SECONDS} s", c("p99") <= MAX_P99_SECONDS, c("p99")),
        _criterion(5, "0 query errors", c("query_errors") == 0, c("query_errors")),
    ]
    return ConfirmTally(stats, recovery, fault_counts(acts), _criteria(stats, rows))
