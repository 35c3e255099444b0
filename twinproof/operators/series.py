"""Operators over one time-ordered series per key: time in state, counter rates, streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinproof.functions.clock import ticks
from twinproof.functions.names import SETTLE_SECONDS

from . import ordered

MICROS = 1_000_000


def running_since(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], running: Column, hold_seconds: int = SETTLE_SECONDS, **kw
) -> DataFrame:
    """Per poll: since when the state has been running without a break, and whether that is long enough to check.

    Any other state resets the clock. ``order`` starts with the poll time.
    """
    at = order[0]
    splits = kw["splits"] if "splits" in kw else ordered.split_points(polls, at, kw.get("chunks"))
    rows = polls.withColumn("_running", F.coalesce(running, F.lit(False)))
    rows = ordered.previous(rows, keys, order, {"_was": "_running"}, splits=splits)
    begins = F.when(F.col("_running") & ~F.coalesce(F.col("_was"), F.lit(False)), F.col(at))
    rows = ordered.carry(rows, keys, order, {"_began": begins}, splits=splits)
    since = F.when(F.col("_running"), F.col("_began"))
    held = ticks(at) - ticks(since) >= F.lit(hold_seconds * MICROS)
    return rows.select(*polls.columns, since.alias("running_since"), F.coalesce(held, F.lit(False)).alias("ready"))


def counter_rate(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counter: str,
    window_seconds: int = 300,
    name: str = "rate",
) -> DataFrame:
    """Per sample: increase per second of a counter over the trailing window; a drop counts as a restart from zero.

    The series is cut into cells longer than the window; each cell also sees the samples of the window before it,
    so a window never needs more than one cell of one key. No extrapolation to the window's edges.
    """
    at = order[0]
    cell = 12 * window_seconds * MICROS
    rows = samples.withColumn("_us", ticks(at)).withColumn("_cell", F.floor(F.col("_us") / cell).cast("bigint"))
    near_edge = F.pmod(F.col("_us"), F.lit(cell)) >= F.lit(cell - 2 * window_seconds * MICROS)
    rows = rows.withColumn("_home", F.col("_cell"))
    context = F.when(near_edge, F.array(F.col("_cell"), F.col("_cell") + 1)).otherwise(F.array(F.col("_cell")))
    rows = rows.withColumn("_cell", F.explode(context))
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(*order)
    trailing = Window.partitionBy(*keys, "_cell").orderBy("_us").rangeBetween(-window_seconds * MICROS, 0)
    before = F.lag(counter).over(in_cell)
    step = F.when(before.isNull(), F.lit(0)).when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before)
    rows = rows.withColumn("_step", step)
    # The first sample of a window starts it: its own step happened before the window.
    start_us = F.min("_us").over(trailing)
    first_step = F.min_by("_step", F.struct("_us", *order[1:])).over(trailing)
    rows = rows.withColumns({
        "_rise": F.sum("_step").over(trailing) - first_step,
        "_span": (F.col("_us") - start_us) / F.lit(float(MICROS)),
    })
    home = rows.where(F.col("_cell") == F.col("_home"))
    return home.select(*samples.columns, F.when(F.col("_span") > 0, F.col("_rise") / F.col("_span")).alias(name))


def streak(rows: DataFrame, keys: Sequence[str], order: Sequence[str], good: Column, name: str = "streak", **kw) -> DataFrame:
    """Per row: how many rows in a row, ending here, were good. Act once it reaches k (hysteresis)."""
    splits = kw["splits"] if "splits" in kw else ordered.split_points(rows, order[0], kw.get("chunks"))
    marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    marked = ordered.running(marked, keys, order, "_place", F.lit(1), splits=splits)
    marked = ordered.carry(marked, keys, order, {"_bad_at": F.when(~F.col("_good"), F.col("_place"))}, splits=splits)
    return marked.select(*rows.columns, (F.col("_place") - F.coalesce("_bad_at", F.lit(0))).cast("bigint").alias(name))
