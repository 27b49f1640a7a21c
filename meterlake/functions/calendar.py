"""Time buckets, budget periods and report ranges. All times are UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "week", "month")
PERIODS = ("daily", "weekly", "monthly")
DEFAULT_RANGE_DAYS = 30


DAY_MICROS = 86_400_000_000


def utc_date(ts: Column) -> Column:
    """The UTC calendar day of an instant, whatever the session's time zone is.

    Day functions of Spark see instants in the session's zone. From here on only
    dates are used, which have none.
    """
    micros = F.unix_micros(ts)
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("int"))


def utc_text(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffff`` of an instant in UTC."""
    micros = F.pmod(F.unix_micros(ts), F.lit(DAY_MICROS))
    seconds = ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("int")

    def two(value: Column) -> Column:
        return F.lpad(value.cast("int").cast("string"), 2, "0")

    return F.concat(
        utc_date(ts).cast("string"),
        F.lit("T"), two(F.floor(seconds / 3600)),
        F.lit(":"), two(F.floor(seconds / 60) % 60),
        F.lit(":"), two(seconds % 60),
        F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"),
    )


def monday_zero_week(ts: Column) -> Column:
    """``YYYY-Www`` with Monday weeks, days before the first Monday in week 00."""
    day = utc_date(ts)
    number = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.substring(day.cast("string"), 1, 4), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def iso_week(ts: Column) -> Column:
    """``YYYY-Www`` of the ISO calendar."""
    day = utc_date(ts)
    return F.concat(
        F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"),
        F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
    )


def bucket_key(ts: Column, granularity: str) -> Column:
    """The time-series bucket of ``ts``."""
    if granularity == "hour":
        return F.substring(utc_text(ts), 1, 13)
    if granularity == "day":
        return utc_date(ts).cast("string")
    if granularity == "week":
        return monday_zero_week(ts)
    if granularity == "month":
        return F.substring(utc_date(ts).cast("string"), 1, 7)
    raise ValueError(f"granularity must be one of {GRANULARITIES}, got {granularity!r}")


def period_key(ts: Column, period: str) -> Column:
    """The calendar key of the budget period that holds ``ts``."""
    if period == "daily":
        return utc_date(ts).cast("string")
    if period == "weekly":
        return iso_week(ts)
    if period == "monthly":
        return F.substring(utc_date(ts).cast("string"), 1, 7)
    raise ValueError(f"period must be one of {PERIODS}, got {period!r}")


def as_utc(moment: dt.datetime) -> dt.datetime:
    """``moment`` in UTC; a naive value is taken as UTC."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=dt.timezone.utc)
    return moment.astimezone(dt.timezone.utc)


def period_bounds(period: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """Half-open ``[start, end)`` of the period that holds ``now``; weeks start Monday."""
    midnight = as_utc(now).replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "daily":
        return midnight, midnight + dt.timedelta(days=1)
    if period == "weekly":
        start = midnight - dt.timedelta(days=midnight.weekday())
        return start, start + dt.timedelta(days=7)
    if period == "monthly":
        start = midnight.replace(day=1)
        return start, (start + dt.timedelta(days=32)).replace(day=1)
    raise ValueError(f"period must be one of {PERIODS}, got {period!r}")


def moment(value: str | dt.datetime, name: str) -> dt.datetime:
    """An ISO date, ISO date-time or ``datetime`` as a UTC ``datetime``."""
    if isinstance(value, dt.datetime):
        return as_utc(value)
    try:
        return as_utc(dt.datetime.fromisoformat(value.strip()))
    except ValueError as error:
        raise ValueError(f"{name} is not an ISO-8601 date or date-time: {value!r}") from error


def resolve_range(
    start: str | dt.datetime | None,
    end: str | dt.datetime | None,
    now: dt.datetime,
    default_days: int = DEFAULT_RANGE_DAYS,
) -> tuple[dt.datetime, dt.datetime]:
    """The report range; without ``start``, the ``default_days`` before its end."""
    upper = moment(end, "end") if end else as_utc(now)
    lower = moment(start, "start") if start else upper - dt.timedelta(days=default_days)
    if lower > upper:
        raise ValueError("start must be on or before end")
    return lower, upper


def span_days(start: dt.datetime, end: dt.datetime) -> float:
    """Length of a window in days, at least one."""
    return max((end - start).total_seconds() / 86400.0, 1.0)
