"""From a differing checksum to the rows behind it: a tree of sums, of which only differing ranges are split further.

At 64 buckets of a huge table one bad bucket says little. Each level splits the ranges that still differ and compares their sums on
all sides, until a range is a single key. Only rows of differing ranges are read: few ranges become filters on the key, which
reach the scan and skip files; many meet the rows by an equal join on the range's number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from twinproof.functions.names import BUCKETS
from twinproof.functions.terms import Term, term_sum
from twinproof.session import pinned

from .fold import fold_terms
from .reconcile import SIDE, SOURCE, TableSpec, bucket_of, is_checkable, key_bounds, terms_for, union_replicas

#: Ranges up to which they are filters at the scan.
AS_FILTER = 64


def _inside(key: str, ranges: Sequence[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(key).between(F.lit(int(low)), F.lit(int(high))) for low, high in ranges])


def _merged(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _sums(rows: DataFrame, bucket: Column, terms: Sequence[Term]) -> DataFrame:
    added = rows.groupBy(SIDE, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("_n"), *[term_sum(t.alias).alias(t.alias) for t in terms])
    return added.select(SIDE, "bucket", F.concat_ws("|", F.col("_n").cast("string"), *[F.col(t.alias).cast("string") for t in terms]).alias("sums"))


def drill_down(
    source: DataFrame, replicas: Mapping[str, DataFrame], spec: TableSpec, fan: int = BUCKETS, strict: bool = False
) -> DataFrame:
    """``key``, ``replica``, ``source_sums``, ``replica_sums`` of every single key that differs; sums are empty where there is no row.

    Keys that only a replica holds are found wherever they lie. A level is one Spark job; its differing ranges stay in the cluster, only
    their number and, if they are few, their bounds come to the driver. Rows with a NULL key are one range, key NULL. Raises
    ValueError where the key is not one whole-number column.
    """
    spark = source.sparkSession
    if not is_checkable(source.schema, spec.primary_key):
        raise ValueError(f"{spec.name}: the key must be one whole-number column")
    key, names = spec.primary_key[0], list(replicas)
    terms = terms_for(source, spec, strict)
    exprs = {t.alias: t.expr for t in terms}
    log = union_replicas(replicas)
    order_by = list(spec.order_by) if key in spec.order_by else [*spec.order_by, key]
    bounds = key_bounds(source, key).unionByName(key_bounds(log, key)).agg(F.min("lo"), F.max("hi")).first()
    lo, hi = bounds
    width = 1
    while width * fan <= hi - lo:
        width *= fan

    def sides(keep) -> DataFrame:
        own = keep(source).select(F.lit(SOURCE + ":").alias(SIDE), key, *[e.alias(n) for n, e in exprs.items()])
        held = keep(log)
        theirs = fold_terms(held, [SIDE, *order_by], exprs) if spec.folded else held.select(SIDE, key, *[e.alias(n) for n, e in exprs.items()])
        return own.unionByName(theirs.select(*own.columns))

    def differing(rows: DataFrame, bucket: Column) -> DataFrame:
        sums = _sums(rows, bucket, terms).groupBy("bucket").agg(
            F.coalesce(F.max(F.when(F.col(SIDE) == SOURCE + ":", F.col("sums"))), F.lit("")).alias("source_sums"),
            *[F.coalesce(F.max(F.when(F.col(SIDE) == n, F.col("sums"))), F.lit("")).alias(f"_r{i}") for i, n in enumerate(names)])
        # The same sums may hide a difference of two replicas, never of one and the source: each is compared on its own.
        return sums.where(reduce(lambda a, b: a | b, [F.col(f"_r{i}") != F.col("source_sums") for i in range(len(names))]))

    keep = lambda df: df
    while True:
        bad = pinned(differing(sides(keep), bucket_of(key, lo, width)))
        if width == 1:
            break
        n = bad.count()
        wide = width
        if n <= AS_FILTER:
            buckets = [r["bucket"] for r in bad.select("bucket").collect()]
            ranges = _merged([(lo + b * wide, lo + (b + 1) * wide - 1) for b in buckets if b is not None])
            where = _inside(key, ranges) if ranges else F.lit(False)
            if None in buckets:
                where = where | F.col(key).isNull()
            keep = lambda df, where=where: df.where(where)
        else:
            marked = bad.select(F.col("bucket").alias("_bad"))
            keep = lambda df, marked=marked, wide=wide: df.join(marked, bucket_of(key, lo, wide).eqNullSafe(F.col("_bad")), "left_semi")
        if n == 0:
            break
        width //= fan
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("replica"), F.col(f"_r{i}").alias("replica_sums")) for i, name in enumerate(names)]))
    rows = bad.select((F.col("bucket") + F.lit(lo)).cast("bigint").alias("key"), "source_sums", each.alias("r"))
    return rows.select("key", "r.replica", "source_sums", "r.replica_sums").where(F.col("source_sums") != F.col("replica_sums"))
