"""Put small aggregate results together without joining them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def side_by_side(*parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (per ``by``) with the columns of all parts, each of which holds one row (per ``by``).

    A join of one-row results on a constant would be planned as a nested loop; a union and one small aggregation is not.
    """
    names = [c for p in parts for c in p.columns if c not in by]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*by).agg(*[F.any_value(F.col(c), True).alias(c) for c in names])
