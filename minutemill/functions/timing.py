"""UTC day and minute helpers. Every read takes an explicit `as_of` instant."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc(as_of: datetime | str) -> datetime:
    """An aware UTC datetime; naive values and plain strings are taken as UTC."""
    value = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def instant(as_of: datetime | str) -> Column:
    return F.lit(utc(as_of))


def day_of(as_of: datetime | str) -> date:
    return utc(as_of).date()


def day_start(as_of: datetime | str) -> datetime:
    return utc(as_of).replace(hour=0, minute=0, second=0, microsecond=0)


def minute_start(as_of: datetime | str) -> datetime:
    return utc(as_of).replace(second=0, microsecond=0)


def series_start(as_of: datetime | str, minutes: float) -> datetime:
    """First minute of the last `minutes` minutes; a fractional length is cut toward zero.

    The current minute is included, so 15 minutes span 16 buckets.
    """
    return minute_start(as_of) - timedelta(minutes=int(minutes))


def to_minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts)


def to_day(ts: Column | str) -> Column:
    return F.to_date(ts)


def known_at(events: DataFrame, as_of: datetime | str) -> DataFrame:
    """Events that had arrived by `as_of`.

    The windows below have no upper bound, so a past `as_of` needs this first.
    """
    kept = events.filter(F.col("ts") <= instant(as_of))
    if "day" in events.columns:
        kept = kept.filter(F.col("day") <= F.lit(day_of(as_of)))
    return kept
