"""Dates and times of the day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from duskline.functions.text import read_as


def second_of_day(time: Column, strict: bool = True) -> Column:
    """Seconds since midnight of an ``HH:MM:SS`` text.

    A text that is no time stops the job; with ``strict=False`` it becomes null. The text is put
    behind a fixed date so that Spark's plain timestamp cast can read it, which needs no
    pattern formatter and no session time zone.
    """
    midnight = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    text = F.when(time.contains(":"), F.concat(F.lit("1970-01-01 "), time))
    value = F.timestamp_diff("SECOND", midnight, text.try_cast("timestamp_ntz")).cast("int")
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit("not a time: "), time)).cast("int")
    return F.when(time.isNull() | value.isNotNull(), value).otherwise(bad)


def hour_of(seconds: Column) -> Column:
    return F.floor(seconds / 3600).cast("int")


def minute_of(seconds: Column) -> Column:
    """Minute of the day, seconds cut off."""
    return F.floor(seconds / 60).cast("int")


def clock_text(stamp: Column) -> Column:
    return F.date_format(stamp, "HH:mm:ss")


def stop_date(text: Column, strict: bool = True) -> Column:
    """Day of a stop from the first ten characters of its date text."""
    return read_as(F.substring(text, 1, 10), "date", strict)


def number(text: Column, strict: bool = True) -> Column:
    return read_as(text, "double", strict)


def weekday(date: Column) -> Column:
    """0 is Monday, 6 is Sunday."""
    return F.weekday(date)
