"""Comparable checksum terms: one numeric, fixed-width term per column whose sum both sides agree on.

A term is a per-row expression. Summing terms instead of raw columns keeps text out of every shuffle: the fold
and the aggregates below it carry only numbers, which also keeps them in hash aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from .clock import epoch_seconds


@dataclass(frozen=True)
class Term:
    column: str
    kind: str
    expr: Column

    @property
    def alias(self) -> str:
        return f"t_{self.column}"


def comparable_terms(schema: T.StructType, json_columns: Iterable[str] = (), skip: Iterable[str] = ()) -> list[Term]:
    """Terms for integers, booleans, times, text and JSON text; other types have no term (rounding, binary, nested).

    Text is measured in bytes, never characters. JSON text is measured with all whitespace removed.
    """
    json_columns, skip = set(json_columns), set(skip)
    out: list[Term] = []
    for field in schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if field.name in skip:
            continue
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append(Term(field.name, "integer", c.cast("bigint")))
        elif isinstance(t, T.BooleanType):
            out.append(Term(field.name, "boolean", c.cast("int").cast("bigint")))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(Term(field.name, "time", epoch_seconds(c)))
        elif isinstance(t, (T.StringType, T.CharType, T.VarcharType)) and field.name in json_columns:
            out.append(Term(field.name, "json", F.octet_length(F.regexp_replace(c, r"\s", "")).cast("bigint")))
        elif isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
            out.append(Term(field.name, "text", F.octet_length(c).cast("bigint")))
    return out


def term_sum(c: str | Column) -> Column:
    """Exact sum as decimal(38,0): NULLs add nothing, an empty input sums to zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))


def strict_term(schema: T.StructType, skip: Iterable[str] = ()) -> Term:
    """A per-row 64-bit hash over every hashable column, for same-length edits that plain terms cannot see."""
    skip = set(skip)
    cols = [F.col(f"`{f.name}`") for f in schema.fields if f.name not in skip and not isinstance(f.dataType, T.MapType)]
    return Term("row_hash", "hash", F.xxhash64(*cols))
