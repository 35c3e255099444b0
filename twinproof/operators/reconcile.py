"""Reconciliation of a source table with every replica: live rows per day, typed checksums per key range.

Replicas are data, not code paths: all of them are one long DataFrame with a ``replica`` column, folded and
aggregated together. Only per-day and per-bucket aggregates leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from twinproof.functions.clock import NO_TIME_DAY, NULL_DAY, day_key
from twinproof.functions.names import BUCKETS, DELETED, SKIP_NOT_SINGLE_KEY, VERSION
from twinproof.functions.terms import Term, comparable_terms, strict_term, term_sum

from .fold import fold, fold_terms
from .onerow import side_by_side

SIDE = "side"
SOURCE = "source"


@dataclass(frozen=True)
class TableSpec:
    """What a check needs to know of a planned table."""

    name: str
    primary_key: Sequence[str]
    order_by: Sequence[str]
    time_column: str | None = None
    json_columns: Sequence[str] = field(default_factory=tuple)
    folded: bool = True  # False: append-only replica without versions


def union_replicas(replicas: Mapping[str, DataFrame]) -> DataFrame:
    """All replicas as one DataFrame with a ``side`` column."""
    tagged = [df.withColumn(SIDE, F.lit(name)) for name, df in replicas.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def count_days(live: DataFrame, time_column: str | None, *by: str) -> DataFrame:
    """Live rows per UTC day (per side): partial counts first, so the exchange carries days, not rows."""
    return live.groupBy(*by, day_key(time_column).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def replica_days(replicas: Mapping[str, DataFrame], spec: TableSpec) -> DataFrame:
    log = union_replicas(replicas)
    needed = [c for c in [spec.time_column] if c]
    if spec.folded:
        log = fold(log, [SIDE, *spec.order_by], [SIDE, *needed])
    return count_days(log, spec.time_column, SIDE)


def check_days(
    source: DataFrame, replicas: Mapping[str, DataFrame], spec: TableSpec, today: str
) -> DataFrame:
    """One row per day present on any side.

    Columns: ``table``, ``day``, ``source_rows``, ``replica_rows`` (map replica to count), ``same``, ``settled``,
    ``line`` (``2026-09-01 source=10 a=9``). Days before ``today`` are settled and judged. A table without a time
    column has the single day ``all``, and rows without a time the day ``<null>``; both count as settled, for no later day
    could ever settle them.
    """
    names = list(replicas)
    sides = count_days(source, spec.time_column).withColumn(SIDE, F.lit(SOURCE + ":"))
    counts = sides.unionByName(replica_days(replicas, spec))
    per_day = counts.groupBy("day").agg(
        F.coalesce(F.sum(F.when(F.col(SIDE) == SOURCE + ":", F.col("n"))), F.lit(0)).alias("source_rows"),
        *[
            F.coalesce(F.sum(F.when(F.col(SIDE) == name, F.col("n"))), F.lit(0)).alias(f"_r{i}")
            for i, name in enumerate(names)
        ],
    )
    rows = [F.col(f"_r{i}") for i in range(len(names))]
    same = reduce(lambda a, b: a & b, [r == F.col("source_rows") for r in rows], F.lit(True))
    line = F.concat(
        F.col("day"), F.lit(" source="), F.col("source_rows").cast("string"),
        *[x for name, r in zip(names, rows) for x in (F.lit(f" {name}="), r.cast("string"))],
    )
    pairs = [x for name, r in zip(names, rows) for x in (F.lit(name), r)]
    return per_day.select(
        F.lit(spec.name).alias("table"),
        "day",
        "source_rows",
        F.create_map(*pairs).alias("replica_rows"),
        same.alias("same"),
        (F.col("day").isin(NO_TIME_DAY, NULL_DAY) | (F.col("day") < F.lit(today))).alias("settled"),
        line.alias("line"),
    )


def summarise_days(days: DataFrame) -> DataFrame:
    """One row per table: totals, ``bad_days`` lines (settled only), ``unsettled`` map and ``ok``.

    The collected lists are bounded by the calendar, not by rows.
    """
    bad = F.col("settled") & ~F.col("same")
    open_ = ~F.col("settled") & ~F.col("same")
    entries = F.explode_outer(F.map_entries("replica_rows"))
    totals = (
        days.select("table", entries.alias("e"))
        .groupBy("table", F.col("e.key").alias("replica"))
        .agg(F.sum("e.value").alias("n"))
        .groupBy("table")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("replica", "n")))).alias("replica_rows"))
    )
    main = days.groupBy("table").agg(
        F.sum("source_rows").alias("source_rows"),
        F.count_if(bad).alias("bad_day_count"),
        F.array_sort(F.collect_list(F.when(bad, F.col("line")))).alias("bad_days"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(open_, F.struct("day", "line"))))).alias("unsettled"),
        (F.count_if(bad) == 0).alias("ok"),
    )
    return side_by_side(main, totals, by=("table",)).withColumn("error", F.lit(None).cast("string"))


_FAILED = "table string, ok boolean, error string"


def check_tables(tables: Iterable[tuple[TableSpec, DataFrame, Mapping[str, DataFrame]]], today: str) -> DataFrame:
    """Check several tables; one that cannot be read or evaluated is reported in ``error`` and does not stop the others.

    Each table is an action of its own that yields one row, bounded by the calendar; the rows are put together here.
    """
    parts, spark = [], None
    for spec, source, replicas in tables:
        spark = source.sparkSession
        try:
            checked = summarise_days(check_days(source, replicas, spec, today))
            parts.append(spark.createDataFrame(checked.collect(), checked.schema))
        except Exception as e:  # noqa: BLE001 - reported as data
            parts.append(spark.createDataFrame([(spec.name, False, str(e).split("\n")[0])], _FAILED))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- key-range checksums ----------------------------------------------------------------------------------------

def key_bounds(source: DataFrame, key: str) -> DataFrame:
    """Smallest and largest key of the source, 0 for an empty table."""
    return source.agg(
        F.coalesce(F.min(key), F.lit(0)).cast("bigint").alias("lo"), F.coalesce(F.max(key), F.lit(0)).cast("bigint").alias("hi")
    )


def bucket_width(lo: int, hi: int, buckets: int = BUCKETS) -> int:
    return (hi - lo) // buckets + 1


def bucket_of(key: str | Column, lo: int, width: int) -> Column:
    """Floor division also below ``lo``: rows only a replica holds get buckets below 0 or above the last.

    Whole-number arithmetic throughout; keys so far out that ``key - lo`` could overflow go through decimals.
    """
    k = (F.col(key) if isinstance(key, str) else key).cast("bigint")

    def floor_div(x: Column, w: Column) -> Column:
        return x - F.pmod(x, w)

    w = F.lit(width).cast("bigint")
    wide_x, wide_w = k.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)"), w.cast("decimal(20,0)")
    exact = (floor_div(wide_x, wide_w) / wide_w).cast("bigint")
    safe = 1 << 62
    if not -safe < lo < safe:
        return exact
    fast = F.call_function("div", floor_div(k - F.lit(lo).cast("bigint"), w), w)
    return F.when(k.between(F.lit(-safe), F.lit(safe)), fast).otherwise(exact)


def is_checkable(schema: T.StructType, primary_key: Sequence[str]) -> bool:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return len(primary_key) == 1 and isinstance(schema[primary_key[0]].dataType, whole)


def _sums(rows: DataFrame, by: Sequence[str], bucket: Column, terms: Sequence[Term]) -> DataFrame:
    """Per bucket: row count and term sums, joined by ``|``. 64 groups: partial aggregation does nearly all work."""
    sums = rows.groupBy(*by, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("_n"), *[term_sum(t.alias).alias(t.alias) for t in terms]
    )
    text = F.concat_ws("|", F.col("_n").cast("string"), *[F.col(t.alias).cast("string") for t in terms])
    return sums.select(*by, "bucket", text.alias("sums"))


def terms_for(source: DataFrame, spec: TableSpec, strict: bool = False) -> list[Term]:
    terms = comparable_terms(source.schema, spec.json_columns, skip=(VERSION, DELETED, SIDE))
    return [*terms, strict_term(source.schema, skip=(VERSION, DELETED, SIDE))] if strict else terms


def source_buckets(source: DataFrame, spec: TableSpec, lo: int, width: int, strict: bool = False) -> DataFrame:
    terms = terms_for(source, spec, strict)
    key = spec.primary_key[0]
    rows = source.select(key, *[t.expr.alias(t.alias) for t in terms])
    return _sums(rows, [], bucket_of(key, lo, width), terms)


def replica_buckets(
    replicas: Mapping[str, DataFrame], spec: TableSpec, terms: Sequence[Term], lo: int, width: int
) -> DataFrame:
    log, key = union_replicas(replicas), spec.primary_key[0]
    exprs = {t.alias: t.expr for t in terms}
    if spec.folded:
        order_by = list(spec.order_by) if key in spec.order_by else [*spec.order_by, key]
        rows = fold_terms(log, [SIDE, *order_by], exprs)
    else:
        rows = log.select(SIDE, key, *[e.alias(n) for n, e in exprs.items()])
    return _sums(rows, [SIDE], bucket_of(key, lo, width), terms)


def check_buckets(
    source: DataFrame, replicas: Mapping[str, DataFrame], spec: TableSpec, buckets: int = BUCKETS, strict: bool = False
) -> DataFrame:
    """One row per bucket present on any side.

    Columns: ``table``, ``bucket``, ``low``, ``high``, ``source_sums``, ``replica_sums`` (map), ``same``, ``line``.
    Bounds come from the source only. A table whose key is not one whole-number column is skipped: one row with a
    NULL bucket and the reason in ``line``. ``strict`` adds a hash over whole rows.
    """
    spark = source.sparkSession
    if not is_checkable(source.schema, spec.primary_key):
        return spark.range(1).select(
            F.lit(spec.name).alias("table"),
            F.lit(None).cast("bigint").alias("bucket"),
            F.lit(None).cast("bigint").alias("low"),
            F.lit(None).cast("bigint").alias("high"),
            F.lit(None).cast("string").alias("source_sums"),
            F.lit(None).cast("map<string,string>").alias("replica_sums"),
            F.lit(True).alias("same"),
            F.lit(SKIP_NOT_SINGLE_KEY).alias("line"),
        )
    key, names = spec.primary_key[0], list(replicas)
    lo, hi = key_bounds(source, key).first()
    width = bucket_width(lo, hi, buckets)
    terms = terms_for(source, spec, strict)
    sides = source_buckets(source, spec, lo, width, strict).withColumn(SIDE, F.lit(SOURCE + ":")).unionByName(
        replica_buckets(replicas, spec, terms, lo, width)
    )
    wide = sides.groupBy("bucket").agg(
        F.coalesce(F.max(F.when(F.col(SIDE) == SOURCE + ":", F.col("sums"))), F.lit("")).alias("source_sums"),
        *[
            F.coalesce(F.max(F.when(F.col(SIDE) == name, F.col("sums"))), F.lit("")).alias(f"_r{i}")
            for i, name in enumerate(names)
        ],
    )
    got = [F.col(f"_r{i}") for i in range(len(names))]
    same = reduce(lambda a, b: a & b, [g == F.col("source_sums") for g in got], F.lit(True))
    low = F.lit(lo).cast("decimal(20,0)") + F.col("bucket") * F.lit(width).cast("decimal(20,0)")
    differing = F.concat(
        *[F.when(g != F.col("source_sums"), F.concat(F.lit(f" {n}=["), g, F.lit("]"))).otherwise("") for n, g in zip(names, got)]
    )
    high = low + F.lit(width - 1).cast("decimal(20,0)")
    line = F.concat(
        F.lit(f"{key} "), low.cast("string"), F.lit(".."), high.cast("string"), F.lit(": source=["), "source_sums", F.lit("]"), differing
    )
    return wide.select(
        F.lit(spec.name).alias("table"),
        "bucket",
        # A bucket may reach past the largest bigint; the line shows its bounds in full.
        low.try_cast("bigint").alias("low"),
        high.try_cast("bigint").alias("high"),
        "source_sums",
        F.create_map(*[x for n, g in zip(names, got) for x in (F.lit(n), g)]).alias("replica_sums"),
        same.alias("same"),
        line.alias("line"),
    )


def fingerprint(live: DataFrame, terms: Sequence[Term], *by: str) -> DataFrame:
    """Whole-table fingerprint: row count and term sums in one string."""
    sums = live.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[term_sum(t.expr).alias(t.alias) for t in terms]
    )
    text = F.concat_ws("|", F.col("_n").cast("string"), *[F.col(t.alias).cast("string") for t in terms])
    return sums.select(*by, text.alias("fingerprint"))


def show_first(lines: DataFrame, per: str, order: str, k: int) -> DataFrame:
    """The first ``k`` differing lines per table and how many more there are; the full result stays available."""
    bad = lines.where(~F.col("same"))
    # Lines are one per day or bucket, so a table's group is bounded by the calendar or the bucket count.
    group = Window.partitionBy(per)
    numbered = bad.withColumns({
        "rank": F.row_number().over(group.orderBy(order)), "_total": F.count(F.lit(1)).over(group),
    })
    return numbered.where(F.col("rank") <= k).select(
        per, order, "line", "rank", F.greatest(F.col("_total") - F.lit(k), F.lit(0)).alias("more")
    )


# --- cutover gate -----------------------------------------------------------------------------------------------

def cutover_gate(
    source: DataFrame,
    replicas: Mapping[str, DataFrame],
    spec: TableSpec,
    watermark: int,
    today: str,
    strict: bool = False,
    positions: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One verdict row: has every replica applied the source position ``watermark``, and do both checks agree?

    Unlike the day check, the gate also stops on unsettled differences: writes have stopped, so nothing may differ.
    A checksum skipped for its key type does not stop it. ``positions``: per replica the totals that its ingest keeps, instead of a scan
    of its log for the newest version.
    """
    log = union_replicas(replicas if positions is None else {
        n: p.where("changes > 0").select(F.col("position").alias(VERSION)) for n, p in positions.items()})
    applied = log.groupBy(SIDE).agg(F.max(VERSION).alias("v")).agg(F.min("v").alias("applied"), F.count(F.lit(1)).alias("seen"))
    days = check_days(source, replicas, spec, today).agg(
        F.count_if(F.col("settled") & ~F.col("same")).alias("bad_days"),
        F.count_if(~F.col("settled") & ~F.col("same")).alias("unsettled_days"),
    )
    sums = check_buckets(source, replicas, spec, strict=strict).agg(F.count_if(~F.col("same")).alias("bad_buckets"))
    joined = side_by_side(applied, days, sums)
    reached = (F.col("applied") >= F.lit(watermark)) & (F.col("seen") == F.lit(len(replicas)))
    ready = reached & (F.col("bad_days") == 0) & (F.col("unsettled_days") == 0) & (F.col("bad_buckets") == 0)
    return joined.select(
        F.lit(spec.name).alias("table"),
        F.lit(watermark).cast("bigint").alias("watermark"),
        F.col("applied").cast("bigint").alias("applied"),
        F.coalesce(reached, F.lit(False)).alias("reached"),
        "bad_days",
        "unsettled_days",
        "bad_buckets",
        F.coalesce(ready, F.lit(False)).alias("ready"),
    )
