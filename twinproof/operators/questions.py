"""The four questions asked of event tables, over a plain table or over a folded version log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.clock import ntz, week_monday, week_sunday
from twinproof.functions.names import BENCH_RUNS

from .ordered import interpolated_percentile, order_statistics, rank_floor


def since(df: DataFrame, time_column: str, anchor: str, days: int) -> DataFrame:
    """Rows later than ``days`` before the anchor. The bare column is compared, so the filter reaches the scan."""
    return df.where(F.col(time_column) > ntz(anchor) - F.expr(f"INTERVAL {days} DAYS"))


def settled(df: DataFrame, time_column: str, anchor: str, days: int) -> DataFrame:
    """Completed days only: from ``days`` before the anchor's midnight up to that midnight."""
    midnight = F.date_trunc("DAY", ntz(anchor)).cast("timestamp_ntz")
    t = F.col(time_column)
    return df.where((t >= midnight - F.expr(f"INTERVAL {days} DAYS")) & (t < midnight))


def daily_actives(df: DataFrame, time_column: str, user: str) -> DataFrame:
    """Exact distinct users per day. Spark reduces to (day, user) pairs before and after the shuffle, so a user who
    owns a third of all events costs one row per day."""
    return df.groupBy(F.to_date(time_column).alias("day")).agg(F.count_distinct(user).alias("users"))


def kinds_per_week(df: DataFrame, time_column: str, kind: str, weeks: str = "monday") -> DataFrame:
    """Events per kind per week; the two stores' habits (Monday or Sunday weeks) give different answers."""
    start: Column = {"monday": week_monday, "sunday": week_sunday}[weeks](time_column)
    return df.groupBy(start.alias("week"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def top_accounts(df: DataFrame, account: str, k: int = 10) -> DataFrame:
    """The ``k`` accounts with the most events; equal counts are ordered by account."""
    counts = df.groupBy(account).agg(F.count(F.lit(1)).alias("events"))
    return counts.orderBy(F.desc("events"), account).limit(k)


def p95_continuous(df: DataFrame, path: str, duration: str, p: float = 0.95, **kw) -> DataFrame:
    return interpolated_percentile(df, [path], duration, p, "p95", **kw).drop("n")


def p95_exact(df: DataFrame, path: str, duration: str, p: float = 0.95, **kw) -> DataFrame:
    return order_statistics(df, [path], duration, {"p95": rank_floor(p)}, **kw).drop("n")


def event_questions(anchor: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The four questions over a live events table (``event_id, ts, user_id, event_type, value``)."""
    return {
        "daily active users, last 30 days": lambda e: daily_actives(since(e, "ts", anchor, 30), "ts", "user_id"),
        "events per kind per week": lambda e: kinds_per_week(e, "ts", "event_type"),
        "top 10 accounts by events, last 7 days": lambda e: top_accounts(since(e, "ts", anchor, 7), "user_id"),
        "p95 latency per endpoint, last 30 days": lambda e: p95_continuous(since(e, "ts", anchor, 30), "event_type", "value"),
    }


def run_questions(
    stores: dict[str, DataFrame], questions: dict[str, Callable[[DataFrame], DataFrame]], runs: int = BENCH_RUNS
) -> DataFrame:
    """Time every question on every store; one row per run, from which the medians are computed.

    The answer is computed in full (``noop`` sink) and never moved to the driver. The stores take turns.
    """
    spark = next(iter(stores.values())).sparkSession
    samples = []
    for name, ask in questions.items():
        for run in range(runs):
            for store, table in stores.items():
                t0 = time.perf_counter()
                ask(table).write.format("noop").mode("overwrite").save()
                samples.append((name, store, run, (time.perf_counter() - t0) * 1000))
    return spark.createDataFrame(samples, "query string, store string, run int, ms double")


def summarise_samples(samples: DataFrame) -> DataFrame:
    """Median per query and store. Samples are a handful of runs per pair, hence the built-in percentile."""
    return samples.groupBy("query", "store").agg(
        F.count(F.lit(1)).alias("runs"), F.percentile("ms", F.lit(0.5)).alias("median_ms")
    )

