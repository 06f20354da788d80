"""Point in time, cutoff, age and the expired predicate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_of_literal(as_of: dt.datetime, like: T.DataType) -> Column:
    """``as_of`` (UTC if it has no zone) as a constant of the type of the time column."""
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
    text = as_of.isoformat(sep=" ", timespec="microseconds")
    if isinstance(like, T.TimestampNTZType):
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(f"{text}+00:00").cast("timestamp")


def time_type(df: DataFrame, column: str = "mtime") -> T.DataType:
    return df.schema[column].dataType


def _hours(hours: int | Column) -> Column:
    return hours if isinstance(hours, Column) else F.lit(int(hours))


def cutoff(as_of: Column, hours: int | Column) -> Column:
    """``as_of`` less the retention window; a constant when ``hours`` is one."""
    return as_of - F.make_dt_interval(F.lit(0), _hours(hours), F.lit(0), F.lit(0))


def is_expired(time: Column, as_of: Column, hours: int | Column) -> Column:
    """Strictly older than the cutoff; NULL for an unknown time."""
    return time < cutoff(as_of, hours)


def is_retained(time: Column, as_of: Column, hours: int | Column) -> Column:
    """Complement of :func:`is_expired` that keeps unknown times, in a form readers can push down."""
    return time.isNull() | (time >= cutoff(as_of, hours))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def age_hours(time: Column, as_of: Column) -> Column:
    """Age in hours as a double; NULL for an unknown time."""
    return micros_between(time, as_of) / 3.6e9


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def to_instant(time: Column, data_type: T.DataType) -> Column:
    """A time column as ``timestamp``; one without a zone is read as UTC whatever the session's zone."""
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_micros(micros_between(_epoch(), time))
    return time.cast("timestamp")


def to_utc_wall_clock(time: Column) -> Column:
    """A ``timestamp`` as the UTC wall-clock time without a zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(time), _epoch())
