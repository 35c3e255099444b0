"""Calendar and epoch expressions. All of them assume a UTC session (``session.prepare``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NO_TIME_DAY = "all"
NULL_DAY = "<null>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ticks(c: str | Column) -> Column:
    """Microseconds since 1970 as bigint."""
    return F.unix_micros(_col(c).cast("timestamp"))


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds since 1970, rounded down also before 1970."""
    return _col(c).cast("timestamp").cast("bigint")


def day_key(time_column: str | None) -> Column:
    """``yyyy-MM-dd`` of the UTC day; one key for tables without a time column; NULL times get their own day."""
    if time_column is None:
        return F.lit(NO_TIME_DAY)
    return F.coalesce(F.to_date(F.col(time_column)).cast("string"), F.lit(NULL_DAY))


def week_monday(c: str | Column) -> Column:
    return F.to_date(F.date_trunc("WEEK", _col(c)))


def week_sunday(c: str | Column) -> Column:
    return F.date_sub(F.next_day(F.to_date(_col(c)), "SUN"), 7)


def month_key(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyyMM")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, as double with microseconds kept."""
    return (ticks(end) - ticks(start)) / F.lit(1_000_000.0)
