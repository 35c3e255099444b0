"""Order-dependent operators that never put a whole group, or a whole table, into one task.

The common device is the *chunk*: a group is cut along its order column at split points taken from the data, work
is done per (group, chunk), and only one summary row per (group, chunk) is combined across chunks. A group that
owns a third of all rows is thereby spread over about a third of all chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twinproof.functions.clock import ticks
from twinproof.session import pinned

SPLIT_SAMPLE = 0.1
_CHUNK = "_chunk"
_TICK = "_tick"


def order_value(df: DataFrame, column: str) -> Column:
    """A number that orders like ``column`` (times become microseconds)."""
    t = df.schema[column].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return ticks(column)
    if isinstance(t, T.NumericType):
        return F.col(column)
    raise TypeError(f"{column}: chunks need a numeric or time column, got {t.simpleString()}")


def chunk_count(df: DataFrame) -> int:
    """As many chunks as the session has shuffle partitions, and 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, column: str, chunks: int | None = None) -> list:
    """Fewer than ``chunks`` increasing values that cut the rows into parts of about equal size.

    The driver receives just these values. They shape the distribution of work only: any split points give the same
    result, none at all included, so a sketch over a sample is enough, and points taken from an unfolded log serve its
    folded view.
    """
    parts = chunks or chunk_count(df)
    shares = [i / parts for i in range(1, parts)]
    values = df.select(order_value(df, column).alias("v"))
    if not chunks:
        values = values.sample(SPLIT_SAMPLE, seed=7)
    points = values.select(F.percentile_approx("v", shares, 10 * parts).alias("s")).first()["s"] if shares else None
    return sorted(set(points or []))


def _literal(value) -> str:
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, Decimal):
        return f"{value}BD"
    return f"{value}L"


def chunk_of(name: str, splits: Sequence) -> Column:
    """The number of split points at or below the numeric column ``name``.

    A binary search over literals finds the stretch, a short scan within it the exact place.
    """
    if not splits:
        return F.lit(0)
    width = 1 if len(splits) <= 64 else -(-len(splits) // 64)
    heads = splits[::width]

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({name} >= {_literal(heads[mid])}, {search(mid + 1, hi)}, {search(lo, mid)})"

    stretch = f"coalesce({search(0, len(heads))}, 0)"
    if width == 1:
        return F.expr(stretch)
    parts = ["array(" + ",".join(_literal(s) for s in splits[i : i + width]) + ")" for i in range(0, len(splits), width)]
    inside = f"size(filter(element_at(array({','.join(parts)}), {stretch}), s -> s <= {name}))"
    return F.expr(f"if({stretch} = 0, 0, ({stretch} - 1) * {width} + {inside})")


def _chunked(df: DataFrame, order: str, splits: Sequence) -> DataFrame:
    return df.withColumn(_TICK, order_value(df, order)).withColumn(_CHUNK, chunk_of(_TICK, splits))


def _same_chunk(keys: Sequence[str], chunk: str) -> Column:
    """Rows meet the summary row of their key and chunk (a NULL key is a key like any other)."""
    return reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col(_CHUNK) == F.col(chunk),
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    inclusive: bool = True,
    forward: bool = True,
    chunks: int | None = None,
    splits: Sequence | None = None,
    strict: bool = False,
) -> DataFrame:
    """Add, per row, the nearest non-NULL value at or before it within its key (``forward``), or at or after it.

    ``order`` is a list of column names; its first column is numeric or a time and places the chunks, the others
    break ties. ``inclusive=False`` looks at other rows only; ``strict`` only at rows whose first order column differs,
    so that rows of one time never depend on how they happen to lie.
    """
    if not order or any(not isinstance(c, str) for c in order):
        raise TypeError("order is a list of column names")
    splits = split_points(df, order[0], chunks) if splits is None else splits
    ordering = [F.col(c).asc() if forward else F.col(c).desc() for c in order]
    rows = _chunked(df, order[0], splits)
    rows = rows.withColumns({f"_in_{n}": v for n, v in values.items()})
    place = F.struct(*[F.col(c) for c in order])
    pick = F.max_by if forward else F.min_by

    if strict:  # equal values of the first order column always share a chunk
        towards = F.col(_TICK).asc() if forward else F.col(_TICK).desc()
        local = Window.partitionBy(*keys, _CHUNK).orderBy(towards).rangeBetween(Window.unboundedPreceding, -1)
    else:
        local = Window.partitionBy(*keys, _CHUNK).orderBy(*ordering).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1
        )
    across = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).asc() if forward else F.col(_CHUNK).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per (key, chunk): the value the chunk hands on, then what each chunk receives.
    handed = rows.groupBy(*keys, _CHUNK).agg(
        *[pick(F.col(f"_in_{n}"), F.when(F.col(f"_in_{n}").isNotNull(), place)).alias(f"_out_{n}") for n in values]
    )
    received = handed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(_CHUNK).alias("_c"),
        *[F.last(f"_out_{n}", ignorenulls=True).over(across).alias(f"_got_{n}") for n in values],
    )
    rows = rows.withColumns({f"_local_{n}": F.last(f"_in_{n}", ignorenulls=True).over(local) for n in values})
    joined = rows.join(received, _same_chunk(keys, "_c"), "left")
    return joined.select(*df.columns, *[F.coalesce(f"_local_{n}", f"_got_{n}").alias(n) for n in values])


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], **kw) -> DataFrame:
    """``lag`` over chunks: the named columns of the row just before, NULL for the first row of a key."""
    boxed = {f"_box_{n}": F.struct(F.col(c).alias("v")) for n, c in columns.items()}
    out = carry(df, keys, order, boxed, inclusive=False, **kw)
    return out.select(*df.columns, *[F.col(f"_box_{n}").getField("v").alias(n) for n in columns])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    value: Column,
    kind: str = "sum",
    inclusive: bool = True,
    chunks: int | None = None,
    splits: Sequence | None = None,
) -> DataFrame:
    """Add the running ``sum`` or ``max`` of ``value`` within each key, in order; NULL where nothing precedes."""
    fold = {"sum": F.sum, "max": F.max}[kind]
    splits = split_points(df, order[0], chunks) if splits is None else splits
    rows = _chunked(df, order[0], splits).withColumn("_add", value)
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = rows.groupBy(*keys, _CHUNK).agg(fold("_add").alias("_whole"))
    offsets = per_chunk.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_CHUNK).alias("_c"), fold("_whole").over(before).alias("_offset")
    )
    rows = rows.withColumn("_local", fold("_add").over(local))
    joined = rows.join(offsets, _same_chunk(keys, "_c"), "left")
    if kind == "max":
        total = F.greatest("_local", "_offset")
    else:
        total = F.coalesce(F.col("_local") + F.col("_offset"), "_local", "_offset")
    return joined.select(*df.columns, total.alias(name))


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in the total order ``order``; any sortable types, any direction.

    The sorted rows are written once. Spark's range exchange balances the partitions (a row number breaks ties, so
    even equal rows spread), each partition numbers its own rows, and one count per partition gives the offsets.
    """
    salted = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = pinned(salted.orderBy(*order, "_tie")).withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    )
    # Bounded by the number of partitions, not by rows.
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        F.col("_part").alias("_p"),
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.select(*df.columns, (within + F.col("_offset")).alias(name))


# --- exact order statistics ------------------------------------------------------------------------------------

# Zero-based ranks of the percentile definitions in use; ``n`` is the group's count of non-NULL values.
def rank_floor(p: float):
    """Element at floor(p * n): the exact nearest percentile of the column store, also the length-based p90."""
    return lambda n: F.least(F.floor(F.lit(p) * n), n - 1)


def rank_below(p: float):
    """Element at floor(p * (n - 1)): the nearest rank the verdicts use."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


def rank_upper_median():
    """Element at n // 2: the median, upper one for even n."""
    return lambda n: F.floor(n / 2)


def rank_last():
    return lambda n: n - 1


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    ranks: dict[str, object],
    weight: str | None = None,
    chunks: int | None = None,
    splits: Sequence | None = None,
) -> DataFrame:
    """Exact values at chosen ranks per group, one output column per entry of ``ranks``, plus ``n``.

    With ``weight`` a row stands for that many equal values. Equal values are counted together before the shuffle,
    counts are summed per (group, chunk), and only the chunk that holds a wanted rank is looked at value by value. No
    group is ever sorted in one place unless its distinct values are few. The counted values are written once: the input
    is computed a single time, and split points come from what was written.
    """
    rows = df.where(F.col(column).isNotNull())
    counted = (
        rows.groupBy(*keys, F.col(column).alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )
    counted = pinned(counted)
    splits = split_points(counted, "_v", chunks or chunk_count(counted)) if splits is None else splits
    whole = Window.partitionBy(*keys)
    wanted = lambda n: F.array(*[
        F.struct(F.lit(name).alias("name"), rank(n).cast("bigint").alias("k")) for name, rank in ranks.items()
    ])
    counted = counted.withColumn(_TICK, order_value(counted, "_v")).withColumn(_CHUNK, chunk_of(_TICK, splits))
    per_chunk = counted.groupBy(*keys, _CHUNK).agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_chunk.select(
        *keys,
        F.col(_CHUNK),
        F.col("_c"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"),
        F.sum("_c").over(whole).alias("_n"),
    )
    inside = lambda w: (w["k"] >= F.col("_start")) & (w["k"] < F.col("_start") + F.col("_c"))
    targets = placed.withColumn("_w", F.filter(wanted(F.col("_n")), inside)).where(F.size("_w") > 0).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_CHUNK).alias("_kc"), "_start", "_n", "_w"
    )
    near = counted.join(targets, _same_chunk(keys, "_kc"))
    upto = Window.partitionBy(*keys, _CHUNK).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_end", F.col("_start") + F.sum("_c").over(upto))
    return _at_ranks(near, keys, ranks)


def _at_ranks(near: DataFrame, keys: Sequence[str], ranks: dict[str, object]) -> DataFrame:
    """The values whose run of ranks ``[_end - _c, _end)`` holds a wanted rank, one column per rank."""
    hit = F.filter("_w", lambda w: (w["k"] >= F.col("_end") - F.col("_c")) & (w["k"] < F.col("_end")))
    named = near.withColumn("_hit", hit).where(F.size("_hit") > 0).select(*keys, "_n", "_v", F.explode("_hit").alias("_h"))
    return named.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("_h.name") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def interpolated_percentile(
    df: DataFrame, keys: Sequence[str], column: str, p: float, name: str, chunks: int | None = None, splits: Sequence | None = None
) -> DataFrame:
    """The continuous percentile: linear between the two elements around p * (n - 1)."""
    ranks = {"_lo": rank_below(p), "_hi": lambda n: F.ceil(F.lit(p) * (n - 1))}
    both = order_statistics(df, keys, column, ranks, chunks=chunks, splits=splits)
    at = F.lit(p) * (F.col("n") - 1)
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - F.floor(at))
    return both.select(*keys, "n", value.alias(name))
