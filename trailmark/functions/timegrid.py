"""Time buckets, calendars, named ranges and previous periods.

Nothing here reads the clock: ``as_of`` is always given.  Stored times are UTC (the
session's zone).  With a zone ``tz``, bounds and buckets are wall-clock times there:
a day of a clock change has 23 or 25 hours, an hour that is repeated is one bucket.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVALS = ("minute", "hour", "day", "week", "month")


def local(t: Column, tz: str = "UTC") -> Column:
    """The wall-clock time in a zone at a stored time."""
    return t if tz == "UTC" else F.from_utc_timestamp(t, tz)


def to_utc(t: datetime, tz: str = "UTC") -> datetime:
    """The stored time at a wall-clock time of a zone."""
    return t.replace(tzinfo=ZoneInfo(tz)).astimezone(timezone.utc).replace(tzinfo=None)


def to_local(t: datetime, tz: str = "UTC") -> datetime:
    return t.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def bucket(t: Column, interval: str, week_start: str = "monday", tz: str = "UTC") -> Column:
    """The start of the interval that holds ``t``, a timestamp."""
    if interval not in INTERVALS:
        raise ValueError(f"no such interval: {interval}")
    t = local(t, tz)
    if interval == "week" and week_start == "sunday":
        return F.date_trunc("week", t + F.expr("INTERVAL 1 DAY")) - F.expr("INTERVAL 1 DAY")
    return F.date_trunc(interval, t)


def bucket_from(t: Column, seconds: int, origin: datetime) -> Column:
    """Buckets of a fixed length, counted from an origin."""
    start = F.unix_seconds(F.lit(origin).cast("timestamp"))
    return F.timestamp_seconds(start + F.floor((F.unix_seconds(t) - start) / seconds) * seconds)


def calendar(spark: SparkSession, start: datetime, end: datetime, interval: str, week_start: str = "monday") -> DataFrame:
    """``date``: every bucket from the one of ``start`` up to ``end``, which is not included."""
    return spark.range(1).select(F.explode(buckets(start, end, interval, week_start)).alias("date"))


def buckets(start: datetime, end: datetime, interval: str, week_start: str = "monday") -> Column:
    """The calendar as an array."""
    first = bucket(F.lit(start).cast("timestamp"), interval, week_start)
    last = F.lit(end - timedelta(seconds=1)).cast("timestamp")
    return F.sequence(first, last, F.expr(f"INTERVAL 1 {interval.upper()}"))


def _month(d: datetime, back: int = 0) -> datetime:
    month = d.year * 12 + d.month - 1 - back
    return datetime(month // 12, month % 12 + 1, 1)


def named_range(name: str, as_of: datetime, tz: str = "UTC") -> tuple[datetime, datetime]:
    """Start and end (included) of a named range, in the zone's wall-clock time; ``as_of`` is UTC."""
    as_of = to_local(as_of, tz)
    day = datetime(as_of.year, as_of.month, as_of.day)
    end_of_day = day + timedelta(days=1, milliseconds=-1)
    tick = timedelta(milliseconds=1)
    match name:
        case "30min":
            return as_of - timedelta(minutes=30), as_of
        case "lastHour":
            return as_of - timedelta(hours=1), as_of
        case "today":
            return day, end_of_day
        case "yesterday":
            return day - timedelta(days=1), day - tick
        case "7d":
            return day - timedelta(days=7), end_of_day
        case "30d":
            return day - timedelta(days=30), end_of_day
        case "6m":
            return _month(as_of, 6), end_of_day
        case "12m":
            return _month(as_of, 12), end_of_day
        case "monthToDate":
            return _month(as_of), end_of_day
        case "lastMonth":
            return _month(as_of, 1), _month(as_of) - tick
        case "yearToDate":
            return datetime(as_of.year, 1, 1), end_of_day
        case "lastYear":
            return datetime(as_of.year - 1, 1, 1), datetime(as_of.year, 1, 1) - tick
    raise ValueError(f"no such range: {name}")


def previous_range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The period of equal length before."""
    return start - (end - start) - timedelta(milliseconds=1), start - timedelta(milliseconds=1)


def capped(start: datetime, end: datetime, cap: datetime | None) -> tuple[datetime, datetime]:
    """The range cut at the last visible moment."""
    end = min(end, cap) if cap else end
    return min(start, end), end


def between(column: str, start: datetime, end: datetime, tz: str = "UTC") -> Column:
    """A filter on the stored column, so that it reaches the scan whatever the zone."""
    return F.col(column).between(F.lit(to_utc(start, tz)).cast("timestamp"), F.lit(to_utc(end, tz)).cast("timestamp"))
