"""Dates: epoch conversion, ISO parsing, distances to a reference date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROSECOND_FLOOR = 1e14  # fixed value: epochs above this are microseconds, the rest milliseconds


def epoch_to_date(epoch: Column) -> Column:
    return F.when(epoch > F.lit(MICROSECOND_FLOOR), F.timestamp_micros(epoch)).otherwise(
        F.timestamp_millis(epoch)
    ).cast("date")


def millis_to_timestamp(epoch_ms: Column) -> Column:
    return F.timestamp_millis(epoch_ms.cast("long"))


def parse_iso_date(value: Column) -> Column:
    """Date from a date, timestamp or ISO text; unreadable text gives null instead of failing the job."""
    return value.try_cast("date")


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier).cast("bigint")


def days_until(target: str, now: Column) -> Column:
    return days_between(F.lit(target).cast("date"), now.cast("date"))


def whole_days_since(moment: Column, now: Column) -> Column:
    """Elapsed time in complete 24-hour days, rounded towards minus infinity."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(moment.cast("timestamp"))
    return F.floor(seconds / F.lit(86400)).cast("bigint")
