"""Null, rounding and time helpers shared by constraints and encoders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

EPOCH = "1970-01-01 00:00:00"
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def present(col: Column, dtype: T.DataType) -> Column:
    """The value with NaN read as null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(dtype))
    return col


def column(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` with NaN read as null."""
    return present(F.col(f"`{name}`"), df.schema[name].dataType)


def as_number(df: DataFrame, name: str) -> Column:
    return column(df, name).cast("double")


DAY_MICROS = 86_400_000_000


def micros(col: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970. Wall-clock times are counted without any time zone, so a
    session zone with daylight saving does not bend their differences."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    days = F.unix_date(col.cast("date")).cast("bigint") * F.lit(DAY_MICROS)
    if isinstance(dtype, T.DateType):
        return days
    seconds = F.hour(col) * 3600 + F.minute(col) * 60
    return days + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")


def from_micros(col: Column, dtype: T.DataType) -> Column:
    """The inverse of ``micros``."""
    whole = col.try_cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(whole)
    wall = F.timestamp_add("MICROSECOND", whole, F.lit(EPOCH).cast("timestamp_ntz"))
    return wall if isinstance(dtype, T.TimestampNTZType) else wall.cast(dtype)


def time_number(df: DataFrame, name: str) -> Column:
    return micros(F.col(f"`{name}`"), df.schema[name].dataType)


def literal(value) -> Column:
    """Literal whose time values do not depend on the client's time zone."""
    if isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, dt.date):
        return F.lit(value.isoformat()).cast("date")
    return F.lit(value)


def round_even(col: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals (scaled ``rint``, as array libraries do)."""
    power = float(10 ** abs(digits))
    if digits == 0:
        return F.rint(col)
    if digits > 0:
        return F.rint(col * F.lit(power)) / F.lit(power)
    return F.rint(col / F.lit(power)) * F.lit(power)


def back_to(col: Column, dtype: T.DataType) -> Column:
    """Cast a computed double back to a field's type; whole numbers are truncated."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.cast(dtype)
    return F.nanvl(col.cast("double"), F.lit(None).cast("double")).try_cast(dtype)
