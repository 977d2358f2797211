"""Dates and months as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an unreadable date or month becomes.
NO_DATE, NO_MONTH = "1900-01-01", "2023-12"


def parsed_date(c: Column) -> Column:
    """The date in the first ten characters; unreadable ones lie before every cutoff."""
    return F.coalesce(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), F.lit(NO_DATE).cast("date"))


def month_key(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"), "yyyy-MM"), F.lit(NO_MONTH))


def month_key_of(told: Column, epoch: Column) -> Column:
    """The month of a date text or, where there is none, of seconds since 1970; unreadable ones have the stand-in."""
    return F.when(told.isNull() & epoch.isNotNull(), F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")).otherwise(month_key(told))


def month_start(c: Column) -> Column:
    return F.to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")


def in_window(c: Column, start: str, days: int = 30) -> Column:
    """From the start up to ``days`` later, both midnights included."""
    first = F.lit(start).cast("date")
    return (c >= first.cast("timestamp_ntz")) & (c <= F.date_add(first, days).cast("timestamp_ntz"))


def months_between(first: str, last: str) -> Column:
    """array<date> of month starts."""
    return F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 where there is nothing."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
