"""Audit of injected faults against what the servers themselves logged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twinproof.functions.names import FAULT_EVERY_SECONDS
from twinproof.operators.intervals import exists_within, missing_ticks, schedule_gaps
from twinproof.operators.onerow import side_by_side
from twinproof.session import pinned

from .soak import outage_ends


@dataclass(frozen=True)
class FaultAudit:
    actions: DataFrame
    missing: DataFrame
    skips: DataFrame
    summary: DataFrame


def verify_actions(faults: DataFrame, server_events: DataFrame) -> DataFrame:
    """Each action with ``verified``: did the server log the matching event in time?

    A restart needs a boot line within 180 s; a stop a shutdown line from 5 s before to 60 s after; a start a boot line
    from 5 s before to 180 s after.
    """
    action = F.col("action")
    # Seconds around an action within which its server event counts.
    low = F.when(action == "restart", 0).otherwise(-5)
    high = F.when(action == "stop", 60).otherwise(180)
    want = faults.withColumn("_want_kind", F.when(action == "stop", "stop").otherwise("up"))
    key = ["ts", "action", "service"]
    out = exists_within(want, server_events, ["service"], "ts", "ts", low, high, key, "_want_kind", "kind")
    return out.drop("_want_kind")


def fault_audit(
    faults: DataFrame,
    bounds: DataFrame,
    skips: DataFrame,
    server_events: DataFrame,
    checks: DataFrame,
    every: int = FAULT_EVERY_SECONDS,
    **kw,
) -> FaultAudit:
    """Scheduled, applied, verified, skipped and missing faults; ``ok`` only if all of them agree.

    ``bounds(start, until)`` is the injector's first line. Faults are due ``every`` seconds after the end of the fault
    before (an outage ends with its start line), up to the run's last check.
    """
    seconds = lambda c: F.col(c).cast("timestamp").cast("bigint")
    start = bounds.agg(F.min("start").alias("t")).select(seconds("t").alias("t")).first()["t"]
    last = checks.agg(F.max("ts").alias("t")).select(seconds("t").alias("t")).first()["t"]
    faults = pinned(faults)
    linked = outage_ends(faults, **kw)
    done = F.when(F.col("action") == "stop", F.coalesce("next_start", "ts")).otherwise(F.col("ts"))
    struck = linked.where(F.col("action").isin("restart", "stop")).select(
        seconds("ts").alias("t"), done.cast("timestamp").cast("bigint").alias("done")
    )
    gaps = schedule_gaps(struck, F.lit(start), F.lit(last), every, **kw)
    actions = verify_actions(faults, server_events)
    schedule = gaps.agg(
        (F.sum("missing") + F.count_if("closing_fault_due")).alias("scheduled"), F.sum("missing").alias("missing")
    )
    seen = actions.agg(
        F.count_if(F.col("action").isin("restart", "stop") & (seconds("ts") <= last)).alias("applied"),
        F.count(F.lit(1)).alias("logged"),
        F.count_if("verified").alias("verified"),
    )
    skipped = skips.agg(F.count(F.lit(1)).alias("skipped"))
    summary = side_by_side(schedule, seen, skipped)
    ok = (
        (F.col("applied") == F.col("scheduled")) & (F.col("missing") == 0) & (F.col("skipped") == 0)
        & (F.col("verified") == F.col("logged"))
    )
    return FaultAudit(actions, missing_ticks(gaps, every), skips, summary.withColumn("ok", ok))
