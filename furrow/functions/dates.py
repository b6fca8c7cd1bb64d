"""Lenient dates: what cannot be read becomes NULL instead of an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FORMATS = ("yyyyMMdd", "M/d/yyyy", "yyyy/M/d")


def lenient_timestamp(
    value: Column, dtype: T.DataType, formats: Sequence[str] = DEFAULT_FORMATS
) -> Column:
    """Timestamp without zone of a date, timestamp or text column."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp_ntz")
    text = F.trim(value.cast("string"))
    readings = [text.try_cast("timestamp_ntz")]
    readings += [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*readings)


def assembled_timestamp(year: Column, month: Column, day: Column) -> Column:
    """Midnight of year, month and day; NULL for a date that does not exist."""
    parts = [F.lpad(p.cast("int").cast("string"), n, "0") for p, n in ((year, 4), (month, 2), (day, 2))]
    return F.concat_ws("-", *parts).try_cast("timestamp_ntz")


def days_in_month(year: Column, month: Column) -> Column:
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def month_of_date_key(key: Column) -> Column:
    """Month number of a scene date key: ``YYYY-MM...``, or leading digits ``MM``.

    Unreadable keys give NULL.
    """
    text = key.cast("string")
    sixth = F.substring(text, 6, 2).try_cast("int")
    long_enough = F.length(text) >= 7
    return (
        F.when(long_enough & (F.substring(text, 5, 1) == "-"), sixth)
        .when(text.rlike(r"^\d\d") & long_enough, sixth)
        .when(text.rlike(r"^\d\d"), F.substring(text, 1, 2).try_cast("int"))
    )
