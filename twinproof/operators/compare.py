"""Compare two query answers, as bags or in order, and read from one side while checking the other."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twinproof.functions.names import SHADOW_RATE, SHADOW_TIMEOUT_SECONDS, SIGNIFICANT_DIGITS
from twinproof.functions.normalise import readable, row_text

from twinproof.session import pinned

from .onerow import side_by_side
from .ordered import with_position

Runner = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Mismatch:
    query: str
    match: bool
    left_rows: int
    right_rows: int
    first_different_row: int  # -1 when no position holds two different rows
    detail: str


def bag_counts(left: DataFrame, right: DataFrame, digits: int | None = SIGNIFICANT_DIGITS) -> DataFrame:
    """Each distinct normalised row with its count on both sides: one shuffle, counted before it."""
    l = left.select(row_text(left, digits).alias("row"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    r = right.select(row_text(right, digits).alias("row"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    return l.unionByName(r).groupBy("row").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def bag_difference(left: DataFrame, right: DataFrame, digits: int | None = SIGNIFICANT_DIGITS) -> DataFrame:
    """Rows whose counts differ, with both counts."""
    return bag_counts(left, right, digits).where(F.col("l") != F.col("r")).select(
        readable(F.col("row")).alias("row"), F.col("l").alias("left_count"), F.col("r").alias("right_count")
    )


def ordered_difference(
    left: DataFrame,
    right: DataFrame,
    order: Sequence[str | Column],
    right_order: Sequence[str | Column] | None = None,
    digits: int | None = SIGNIFICANT_DIGITS,
) -> DataFrame:
    """Positions (0-based) at which the two answers hold different rows, or only one of them holds a row.

    A DataFrame has no order of its own, so each side's order is given by its ``ORDER BY`` keys.
    """
    l = with_position(left.withColumn("_row_text", row_text(left, digits)), order).select("position", F.col("_row_text").alias("l"))
    r = with_position(right.withColumn("_row_text", row_text(right, digits)), right_order or order).select(
        F.col("position").alias("_p"), F.col("_row_text").alias("r")
    )
    both = l.join(r, F.col("position") == F.col("_p"), "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select(
        F.coalesce("position", "_p").alias("position"), F.col("l").alias("left_row"), F.col("r").alias("right_row")
    )


def _compare_ordered(name, left, right, order, right_order, digits) -> DataFrame:
    diff = ordered_difference(left, right, order, right_order, digits)
    both = F.col("left_row").isNotNull() & F.col("right_row").isNotNull()
    first = diff.agg(
        F.count(F.lit(1)).alias("differing"),
        F.min(F.when(both, F.col("position"))).alias("first"),
        F.min_by(F.struct("left_row", "right_row"), F.when(both, F.col("position"))).alias("rows"),
    )
    count = F.count(F.lit(1))
    out = side_by_side(left.agg(count.alias("left_rows")), right.agg(count.alias("right_rows")), first)
    out = out.withColumn("query", F.lit(name))
    return _mismatch(
        out, F.col("differing") == 0, F.coalesce("first", F.lit(-1)), F.col("rows.left_row"), F.col("rows.right_row")
    )


def _compare_bag(name, left, right, digits) -> DataFrame:
    bag = bag_counts(left, right, digits)
    found = bag.agg(
        F.min(F.when(F.col("l") != F.col("r"), F.col("row"))).alias("row"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
    ).first()
    at, sizes = found["row"], {n: F.lit(found[n]).cast("bigint") for n in ("left_rows", "right_rows")}
    # Sorted side by side, the answers first part company where the smallest differing row runs out on one side;
    # opposite it stands the next greater row of that side, if there is one.
    if at is None:
        out = left.sparkSession.range(1).select(F.lit(name).alias("query"), *[v.alias(n) for n, v in sizes.items()])
        none = F.lit(None).cast("string")
        return _mismatch(out, F.lit(True), F.lit(-1), none, none)
    here = F.lit(at)
    next_l = F.min(F.when((F.col("row") > here) & (F.col("l") > 0), F.col("row")))
    next_r = F.min(F.when((F.col("row") > here) & (F.col("r") > 0), F.col("row")))
    out = bag.agg(
        F.coalesce(F.sum(F.when(F.col("row") < here, F.col("l"))), F.lit(0)).alias("before"),
        F.max(F.when(F.col("row") == here, F.col("l"))).alias("cl"),
        F.max(F.when(F.col("row") == here, F.col("r"))).alias("cr"),
        next_l.alias("next_l"),
        next_r.alias("next_r"),
    ).withColumns({"query": F.lit(name), **sizes})
    left_row = F.when(F.col("cl") > F.col("cr"), here).otherwise(F.col("next_l"))
    right_row = F.when(F.col("cr") > F.col("cl"), here).otherwise(F.col("next_r"))
    both = left_row.isNotNull() & right_row.isNotNull()
    first = F.when(both, F.col("before") + F.least("cl", "cr")).otherwise(F.lit(-1))
    return _mismatch(out, F.lit(False), first, left_row, right_row)


def _mismatch(df: DataFrame, match: Column, first: Column, left_row: Column, right_row: Column) -> DataFrame:
    l, r = F.coalesce(F.col("left_rows"), F.lit(0)), F.coalesce(F.col("right_rows"), F.lit(0))
    rows = F.concat(F.lit("left ["), readable(left_row), F.lit("] vs right ["), readable(right_row), F.lit("]"))
    counts = F.concat(F.lit("row counts differ: left "), l.cast("string"), F.lit(", right "), r.cast("string"))
    detail = F.when(match, F.lit("")).when(first >= 0, rows).otherwise(counts)
    return df.select(
        "query",
        match.alias("match"),
        l.cast("bigint").alias("left_rows"),
        r.cast("bigint").alias("right_rows"),
        first.cast("bigint").alias("first_different_row"),
        detail.alias("detail"),
    )


def compare(
    name: str,
    left: DataFrame,
    right: DataFrame,
    order: Sequence[str | Column] | None = None,
    right_order: Sequence[str | Column] | None = None,
    digits: int | None = SIGNIFICANT_DIGITS,
) -> DataFrame:
    """One row: do the two answers agree, and if not, where do they first differ?

    Without ``order`` the answers are bags: row order is not part of them, repetitions are. With ``order`` (the
    answers' own sort keys) row *i* is compared with row *i*.
    """
    if order:
        return _compare_ordered(name, left, right, order, right_order, digits)
    return _compare_bag(name, left, right, digits)


# --- reading with a shadow --------------------------------------------------------------------------------------

LEFT_ONLY, SHADOW, RIGHT_ONLY = "left_only", "shadow_read", "right_only"


@dataclass(frozen=True)
class QueryPair:
    """One read, written for both sides."""

    name: str
    left: Runner
    right: Runner
    order: Sequence[str | Column] | None = None


@dataclass
class ShadowReader:
    """Answer from the side the mode selects; in shadow mode also compare a sample of reads in the background.

    The answer is always the plain DataFrame of the selected side. Comparisons run on their own thread, are recorded
    as rows, and neither their result nor their failure reaches the caller. ``rate=0`` means the default rate, a
    negative rate never compares.
    """

    spark: SparkSession
    mode: str = LEFT_ONLY
    rate: float = 0.0
    timeout: float = SHADOW_TIMEOUT_SECONDS
    on_mismatch: Callable[[Mismatch], None] | None = None
    rng: random.Random = field(default_factory=random.Random)
    reads: int = 0
    _pending: list[tuple[str, Future]] = field(default_factory=list)
    _pool: ThreadPoolExecutor = field(default_factory=lambda: ThreadPoolExecutor(2))

    def read(self, pair: QueryPair) -> DataFrame:
        self.reads += 1
        if self.mode == RIGHT_ONLY:
            return pair.right(self.spark)
        answer = pair.left(self.spark)
        if self.mode == SHADOW and self.rng.random() < (self.rate or SHADOW_RATE):
            self._pending.append((pair.name, self._pool.submit(self._shadow, pair, answer)))
        return answer

    def _shadow(self, pair: QueryPair, answer: DataFrame) -> dict:
        row = {"query": pair.name, "match": None, "error": None, "left_ms": 0.0, "right_ms": 0.0}
        tag = f"shadow-{uuid.uuid4().hex}"
        try:
            t0 = time.perf_counter()
            left = pinned(answer)
            t1 = time.perf_counter()
            # A right side, or a comparison, that is too slow has its Spark jobs cancelled, which surfaces here as an error.
            context = self.spark.sparkContext
            context.addJobTag(tag)
            watchdog = threading.Timer(self.timeout, context.cancelJobsWithTag, [tag])
            watchdog.start()
            try:
                right = pinned(pair.right(self.spark))
                t2 = time.perf_counter()
                found = Mismatch(**compare(pair.name, left, right, pair.order).first().asDict())
            finally:
                watchdog.cancel()
                context.removeJobTag(tag)
            row |= {"match": found.match, "left_ms": (t1 - t0) * 1000, "right_ms": (t2 - t1) * 1000}
            if not found.match and self.on_mismatch:
                self.on_mismatch(found)
        except Exception as e:  # noqa: BLE001 - a failing right side is counted, never raised
            row["error"] = str(e).split("\n")[0] or type(e).__name__
        return row

    def comparisons(self) -> DataFrame:
        """Wait for the running comparisons and return all of them, one row each."""
        rows = [f.result() for _, f in self._pending]
        return self.spark.createDataFrame(
            [(r["query"], r["match"], r["error"], r["left_ms"], r["right_ms"]) for r in rows],
            "query string, match boolean, error string, left_ms double, right_ms double",
        )


def shadow_stats(comparisons: DataFrame, *by: str) -> DataFrame:
    """Counters over recorded comparisons: shadowed, matches, mismatches, errors, total time per side.

    Failed comparisons count as shadowed and as errors, and add no time.
    """
    fine = F.col("error").isNull()
    return comparisons.groupBy(*by).agg(
        F.count(F.lit(1)).alias("shadowed"),
        F.count_if(fine & F.col("match")).alias("matches"),
        F.count_if(fine & ~F.col("match")).alias("mismatches"),
        F.count_if(~fine).alias("errors"),
        F.coalesce(F.sum(F.when(fine, F.col("left_ms"))), F.lit(0.0)).alias("left_ms"),
        F.coalesce(F.sum(F.when(fine, F.col("right_ms"))), F.lit(0.0)).alias("right_ms"),
    )


def sampled(df: DataFrame, key: str | Column, rate: float, default: float = SHADOW_RATE) -> DataFrame:
    """A repeatable Bernoulli sample by key hash (md5, which every store has); ``rate=0`` takes the default rate, a negative one nothing."""
    share = default if rate == 0 else max(rate, 0.0)
    key = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.where(number % 1_000_000 < F.lit(int(round(share * 1_000_000))))
