"""Scalar functions on time. All take and give columns; instants are TIMESTAMP in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins start on the epoch, but days on Korean local midnight (UTC+9), unless told otherwise.
DAY_ORIGIN = 54_000
ZONE = "Asia/Seoul"
BINS = {"1m": 60, "1h": 3_600, "1d": 86_400}


def instant(ts: Column) -> Column:
    """A TIMESTAMP of what Parquet may give without zone."""
    return ts.cast("timestamp")


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, as a double."""
    return F.unix_micros(ts) / 1e6


def at_second(s: Column) -> Column:
    return F.timestamp_micros((s * 1_000_000).cast("long"))


def date_bin(ts: Column, size: int | str, origin: int | None = None) -> Column:
    """Start of the bin of ``size`` seconds (or 1m, 1h, 1d) that ``ts`` is in."""
    if origin is None:
        origin = DAY_ORIGIN if size in ("1d", 86_400) else 0
    size = BINS.get(size, size)
    shift, step = origin * 1_000_000, int(size) * 1_000_000
    us = F.unix_micros(ts) - shift
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)) + shift)


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def weekday(ts: Column, zone: str = ZONE) -> Column:
    """0 (Monday) to 6 in local time."""
    return F.weekday(local(ts, zone))


def local_hour(ts: Column, zone: str = ZONE) -> Column:
    return F.hour(local(ts, zone))


def minute_of_day(ts: Column, zone: str = ZONE) -> Column:
    t = local(ts, zone)
    return F.hour(t) * 60 + F.minute(t)


def local_date(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def local_midnight(day: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def minutes_of(clock: Column) -> Column:
    """Minutes of HH:MM; 24:00 is 1440."""
    parts = F.split(clock, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def last_year(day: Column) -> Column:
    """The day one year before; 28 February for 29 February."""
    return F.add_months(day, -12)


def iso(ts: Column, millis: bool = False) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss" + (".SSS" if millis else "") + "'Z'")


def steps_for(duration: Column | float, step: Column, least: int = 1) -> Column:
    """How many steps a duration has, rounded half to even, ``least`` at least."""
    d = F.lit(float(duration)) if isinstance(duration, int | float) else duration
    return F.greatest(F.lit(least), F.rint(d / step).cast("int"))


def in_hours(ts: Column, start: str, end: str, weekdays_only: bool = True, zone: str = ZONE) -> Column:
    """Within operating hours: start inclusive, end exclusive."""
    m = minute_of_day(ts, zone)
    inside = (m >= minutes_of(F.lit(start))) & (m < minutes_of(F.lit(end)))
    return inside & (weekday(ts, zone) < 5) if weekdays_only else inside


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def next_month(day: Column) -> Column:
    return F.add_months(month_start(day), 1)
