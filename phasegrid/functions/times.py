"""Time expressions. The session time zone is UTC (see ``phasegrid.session.configure``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from phasegrid.functions.checks import map_strict
from phasegrid.functions.durations import Every, parse_every
from phasegrid.schema import WEEKDAYS

_EPOCH_MONDAY = 4 * 86_400_000_000  # 1970-01-05


def epoch_to_timestamp(seconds: Column) -> Column:
    """Whole epoch seconds to a UTC timestamp."""
    return F.timestamp_seconds(seconds)


def epoch_micros_to_timestamp(seconds: Column) -> Column:
    """Fractional epoch seconds, as DECIMAL or text, to a timestamp without float error."""
    exact = seconds.try_cast("decimal(20,6)")
    return F.timestamp_micros((exact * 1_000_000).cast("bigint"))


def date_of(ts: Column) -> Column:
    """The UTC day, whatever the time zone of the session."""
    micros, day = F.unix_micros(ts), F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int"))


def iso_weekday(date: Column) -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(date) + 1


def weekday_name(number: Column) -> Column:
    return map_strict(number, dict(enumerate(WEEKDAYS, start=1)))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def local_text(ts: Column, tz: str) -> Column:
    """Wall-clock minute in ``tz``, for display."""
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm")


def utc_text(ts: Column) -> Column:
    """ISO text with the UTC offset; the fraction appears only if there is one."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS"))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.coalesce(fraction, F.lit("")), F.lit("+00:00")
    )


def duration_text(start: Column, end: Column) -> Column:
    """``2 days, 3:04:05``, with the days and the fraction only where they are not zero."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    rest = F.pmod(micros, F.lit(86_400_000_000))
    days = ((micros - rest) / 86_400_000_000).cast("bigint")
    seconds = F.floor(rest / 1_000_000)
    fraction = F.pmod(rest, F.lit(1_000_000))
    clock = F.format_string(
        "%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    )
    return F.concat(
        F.when(days != 0, F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")))
        .otherwise(""),
        clock,
        F.when(fraction != 0, F.format_string(".%06d", fraction)).otherwise(""),
    )


def bucket(
    ts: Column,
    every: str | dt.timedelta | Every,
    *,
    weeks_from_epoch: bool = False,
    shift_days: int = 0,
    origin: Column | None = None,
    tz: str | None = None,
) -> Column:
    """Start of the tumbling window that holds ``ts``; windows include their start.

    Clock and day windows are counted from the epoch, week windows from a Monday moved by
    ``shift_days`` (or from the epoch with ``weeks_from_epoch``), month windows from the calendar.
    With ``origin`` they are counted from that timestamp instead. ``tz`` moves day, week and month
    edges to local midnight; shorter windows do not depend on it, so an hour that a clock change
    repeats stays two windows.
    """
    length = parse_every(every)
    if tz is not None and (length.months or length.micros % 86_400_000_000 == 0):
        local = bucket(
            F.from_utc_timestamp(ts, tz),
            length,
            weeks_from_epoch=weeks_from_epoch,
            shift_days=shift_days,
            origin=None if origin is None else F.from_utc_timestamp(origin, tz),
        )
        return F.to_utc_timestamp(local, tz)
    if length.months:
        return _month_bucket(ts, length.months, origin)
    if origin is not None:
        start = F.unix_micros(origin)
    else:
        monday = length.weekly and not weeks_from_epoch
        start = F.lit((_EPOCH_MONDAY if monday else 0) + shift_days * 86_400_000_000)
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros - start, F.lit(length.micros)))


def _month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def _month_bucket(ts: Column, months: int, origin: Column | None) -> Column:
    if origin is None:
        if months == 1:
            return F.date_trunc("month", ts)
        first = _month_number(ts) - F.pmod(_month_number(ts), F.lit(months))
        return F.make_date(F.floor(first / 12).cast("int"), first % 12 + 1, F.lit(1)).cast("timestamp")
    passed = _month_number(ts) - _month_number(origin)
    passed = passed - (origin + F.make_ym_interval(F.lit(0), passed) > ts).cast("int")
    whole = passed - F.pmod(passed, F.lit(months))
    return origin + F.make_ym_interval(F.lit(0), whole)
