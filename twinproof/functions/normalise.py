"""Make equal answers print equally, whatever store and column type they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .names import FIELD_SEPARATOR, SIGNIFICANT_DIGITS

NULL_MARK = "\x00"  # a NULL never equals the text 'NULL'
# Marks that stand in a text themselves are written differently, so that no text looks like a NULL or a border of fields.
_ESCAPES = (("\x10", "\x10\x10"), (FIELD_SEPARATOR, "\x10s"), (NULL_MARK, "\x10z"))
_NUMERIC_TEXT = r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"


def _number(c: Column, digits: int | None) -> Column:
    if digits is None:
        return c.cast("string")
    value = c.cast("double")
    # Adding zero turns a negative zero into zero.
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == F.lit(float("inf")), F.lit("Infinity"))
        .when(value == F.lit(float("-inf")), F.lit("-Infinity"))
        .otherwise(F.format_string(f"%.{digits - 1}e", value + F.lit(0.0)))
    )


def _text(c: Column, digits: int | None) -> Column:
    if digits is None:
        return c
    numeric = c.rlike(_NUMERIC_TEXT) & c.try_cast("double").isNotNull()
    return F.when(numeric, _number(c.try_cast("double"), digits)).otherwise(c)


def normalised(c: Column, t: T.DataType, digits: int | None = SIGNIFICANT_DIGITS) -> Column:
    """Canonical text of one value: times in UTC at microseconds, booleans as 1/0, numbers and numeric-looking text
    at ``digits`` significant digits, bytes as text. ``digits=None`` compares numbers exactly."""
    if isinstance(t, T.BooleanType):
        one = _number(c.cast("int"), digits)
        out = one
    elif isinstance(t, T.NumericType):
        out = _number(c, digits)
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(t, T.DateType):
        out = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    elif isinstance(t, T.BinaryType):
        out = _text(F.decode(c, "UTF-8"), digits)
    elif isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        out = _text(c, digits)
    elif isinstance(t, T.NullType):
        out = F.lit(None).cast("string")
    else:
        out = F.to_json(F.struct(c.alias("v")))
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType, T.BinaryType)):
        for mark, written in _ESCAPES:
            out = F.replace(out, F.lit(mark), F.lit(written))
    return F.when(c.isNull(), F.lit(NULL_MARK)).otherwise(out)


def row_text(df: DataFrame, digits: int | None = SIGNIFICANT_DIGITS) -> Column:
    """One canonical string per row, columns taken by position."""
    fields = df.schema.fields
    if not fields:
        return F.lit("")
    return F.concat_ws(FIELD_SEPARATOR, *[normalised(F.col(f"`{f.name}`"), f.dataType, digits) for f in fields])


def readable(c: Column) -> Column:
    """The canonical string as people read it."""
    out = F.replace(F.replace(c, F.lit(FIELD_SEPARATOR), F.lit(", ")), F.lit(NULL_MARK), F.lit("NULL"))
    for mark, written in reversed(_ESCAPES):
        out = F.replace(out, F.lit(written), F.lit(mark))
    return out
