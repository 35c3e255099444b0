"""Interval joins of two streams: bounded existence, the next event, overlaps. All are Spark's own stream-stream joins.

Both sides carry a watermark, and the time bounds in the join condition tell Spark how long a row has to wait for partners, so
state is bounded by the widest interval and the lateness. A row without a partner comes out once none can come any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.clock import ticks
from twinproof.operators.intervals import MICROS, _cells


def _timed(stream: DataFrame, at: str, late: str, name: str) -> DataFrame:
    return stream.withColumn(name, F.col(at).cast("timestamp")).withWatermark(name, late)


def _seconds(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} SECONDS")


def exists_within_stream(
    actions: DataFrame, log: DataFrame, keys: Sequence[str], at: str, log_at: str, low: Column, high: Column,
    kind: str, log_kind: str, before: int, after: int, late: str = "10 minutes",
) -> DataFrame:
    """Each distinct action with ``verified``: is there a log event of the wanted kind in [at + low, at + high] seconds?

    ``before`` and ``after`` are the widest bounds that ``low`` and ``high`` (seconds, by action) can take. Verified actions come
    out with their first event, the others once the watermark says that none can come. ``at`` stays the only time column.

    The join meets on time cells too, so that a key with a long history is neither one task nor compared with itself over all times.
    An action lies in the one cell of its time, an event in every cell (two at most) whose actions it can serve.
    """
    width = max(before + after, 1) * MICROS
    left = _timed(actions, at, late, "_at").withColumns({"_low": low, "_high": high})
    left = left.withColumn("_cell", F.floor(ticks("_at") / width).cast("bigint"))
    right = _timed(log.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(log_kind).alias("_kind"), log_at), log_at, late, "_log_at")
    served = _cells(ticks("_log_at") - after * MICROS, ticks("_log_at") + before * MICROS, width)
    right = right.withColumn("_log_cell", F.explode(served))
    met = (F.col(kind) == F.col("_kind")) & F.col("_log_at").between(F.col("_at") - _seconds(before), F.col("_at") + _seconds(after))
    met = met & (F.col("_cell") == F.col("_log_cell"))
    met = met & (ticks("_log_at") - ticks("_at")).between(F.col("_low") * MICROS, F.col("_high") * MICROS)
    for k in keys:
        met = met & (F.col(k) == F.col(f"_k_{k}"))
    found = left.join(right.drop(*([log_at] if log_at in actions.columns else [])), met, "leftOuter")
    once = found.withColumn("verified", F.col("_kind").isNotNull()).select(*actions.columns, "_at", "verified")
    return once.dropDuplicates([*actions.columns, "_at", "verified"]).drop("_at")


def next_after_stream(
    rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark_at: str, name: str, horizon: int, late: str = "10 minutes"
) -> DataFrame:
    """Each distinct row with ``name``: the time of the earliest mark of its key in (at, at + ``horizon`` seconds], or NULL."""
    left = _timed(rows, at, late, "_at")
    right = _timed(marks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(mark_at).alias("_mark")), "_mark", late, "_mark_at")
    met = (F.col("_mark_at") > F.col("_at")) & (F.col("_mark_at") <= F.col("_at") + _seconds(horizon))
    for k in keys:
        met = met & (F.col(k) == F.col(f"_k_{k}"))
    found = left.join(right, met, "leftOuter")
    return found.groupBy(*rows.columns, "_at").agg(F.min("_mark").alias(name)).drop("_at")


def overlap_labels_stream(
    spans: DataFrame, windows: DataFrame, span_key: Sequence[str], begin: str = "beg", end: str = "end", w_begin: str = "w_beg",
    w_end: str = "w_end", label: str = "label", longest_span: int = 3600, longest_window: int = 7200, late: str = "10 minutes",
    cell_seconds: int = 900,
) -> DataFrame:
    """Every span (beg, end] with the sorted distinct labels of the windows that overlap it, empty if there are none.

    The join meets on time cells. A span or window longer than what the caller vouches for fails the query: its
    partners might have left the state already.
    """
    width = cell_seconds * MICROS

    def checked(df: DataFrame, a: str, b: str, most: int) -> DataFrame:
        long = (ticks(b) - ticks(a)) > most * MICROS
        return df.withColumn(b, F.when(long, F.raise_error(F.lit(f"{a} to {b} lasts longer than {most} s"))).otherwise(F.col(b)))

    left = _timed(checked(spans.select(*span_key, begin, end), begin, end, longest_span), end, late, "_end")
    left = left.withColumn("_cell", F.explode(_cells(ticks(begin), ticks(end), width)))
    right = _timed(checked(windows.select(w_begin, w_end, label), w_begin, w_end, longest_window), w_begin, late, "_w")
    right = right.withColumn("_w_cell", F.explode(_cells(ticks(w_begin), ticks(w_end), width)))
    met = (F.col("_cell") == F.col("_w_cell")) & (F.col("_w") < F.col("_end")) & (F.col("_w") > F.col("_end") - _seconds(longest_span + longest_window))
    met = met & (F.col(w_end) > F.col(begin))
    found = left.join(right, met, "leftOuter")
    return found.groupBy(*span_key, begin, end, "_end").agg(F.array_sort(F.collect_set(label)).alias("labels")).drop("_end")
