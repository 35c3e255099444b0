"""Bench samples to medians, speed-up ranges and agreement between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinproof.operators.ordered import interpolated_percentile
from twinproof.session import pinned


def medians(samples: DataFrame, **kw) -> DataFrame:
    """Median per query and store (mean of the middle two for even counts)."""
    out = interpolated_percentile(samples, ["query", "store"], "ms", 0.5, "median_ms", **kw)
    return out.select("query", "store", F.col("n").alias("runs"), "median_ms")


def ratios(middle: DataFrame, base: str) -> DataFrame:
    """Per store the smallest and largest ratio of medians, base over store, over the queries."""
    ref = middle.where(F.col("store") == base).select("query", F.col("median_ms").alias("base_ms"))
    ratio = middle.where(F.col("store") != base).join(ref, "query").select(
        "store", F.try_divide("base_ms", "median_ms").alias("ratio")
    )
    return ratio.groupBy("store").agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"))


def speedups(samples: DataFrame, base: str, **kw) -> DataFrame:
    return ratios(pinned(medians(samples, **kw)), base)


def row_count_agreement(counts: DataFrame) -> DataFrame:
    """``counts(query, store, n)``: did every store return the same number of rows?"""
    return counts.groupBy("query").agg(
        (F.count_distinct("n") == 1).alias("agree"), F.min("n").alias("fewest"), F.max("n").alias("most")
    )


def stale_medians(samples: DataFrame, stored: DataFrame, **kw) -> DataFrame:
    """Stored medians ``(query, store, median_ms)`` that the samples do not recompute to."""
    m = medians(samples, **kw).withColumnRenamed("median_ms", "recomputed_ms")
    both = stored.join(m, ["query", "store"], "left")
    return both.where(~F.col("median_ms").eqNullSafe(F.col("recomputed_ms"))).select("query", "store", "median_ms", "recomputed_ms")


def bench_table(samples: DataFrame, stores: list[str], base: str, **kw) -> DataFrame:
    """One row per query with a median per store and the speed-up of each store over ``base``."""
    wide = medians(samples, **kw).groupBy("query").pivot("store", stores).agg(F.first("median_ms"))
    return wide.select(
        "query", *stores, *[F.try_divide(F.col(base), F.col(s)).alias(f"{s}_speedup") for s in stores if s != base]
    )
