"""Parsers for the age and window-length arguments; both run once, while the plan is built."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

# Accepted spellings and the longest age a device can serve.
_AGE_UNITS = {"w": "weeks", "d": "days", "h": "hours"}
_MAX_AGE = dt.timedelta(days=60, hours=12)

_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
}
_DAY = 86_400_000_000
_MONTHS = {"mo": 1, "q": 3, "y": 12}
_PART = re.compile(r"(\d+)(ns|us|ms|mo|s|m|h|d|w|q|y)")


def parse_age(age: str, now: dt.datetime) -> dt.datetime | None:
    """Lower time bound for ``all`` (no bound), ``max``, or a number of weeks, days or hours."""
    text = age.lower()
    if text == "all":
        return None
    if text == "max":
        return now - _MAX_AGE
    found = re.fullmatch(r"(\d+)([wdh])", text)
    if found is None:
        raise ValueError(f"{age!r} is no age: write all, max, or a number of w, d or h")
    return now - dt.timedelta(**{_AGE_UNITS[found[2]]: int(found[1])})


@dataclass(frozen=True)
class Every:
    """A window length: either whole months or a fixed number of microseconds.

    ``weekly`` marks lengths given in weeks, whose windows start on a Monday instead of at the epoch.
    """

    months: int = 0
    micros: int = 0
    weekly: bool = False


def parse_every(every: str | dt.timedelta | Every) -> Every:
    """Parse ``1h``, ``30m``, ``1d``, ``1w``, ``1mo``, ``1q``, ``1y``, ``1h30m`` or a timedelta."""
    if isinstance(every, Every):
        return every
    if isinstance(every, dt.timedelta):
        length = Every(micros=every // dt.timedelta(microseconds=1))
    else:
        length = _parse_text(every)
    if length.months <= 0 and length.micros <= 0:
        raise ValueError(f"Window length must be positive: {every!r}")
    return length


def _parse_text(text: str) -> Every:
    parts = _PART.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"Invalid window length: '{text}'")
    months = weeks = days = nanos = 0
    for number, unit in parts:
        amount = int(number)
        if unit in _MONTHS:
            months += amount * _MONTHS[unit]
        elif unit == "w":
            weeks += amount
        elif unit == "d":
            days += amount
        else:
            nanos += amount if unit == "ns" else amount * _MICROS[unit] * 1_000
    if sum(bool(x) for x in (months, weeks, days, nanos)) > 1:
        raise ValueError(f"Window length mixes months, weeks, days and clock units: '{text}'")
    if nanos % 1_000:
        raise ValueError(f"Window length is finer than a microsecond: '{text}'")
    return Every(months=months, micros=(weeks * 7 + days) * _DAY + nanos // 1_000, weekly=weeks > 0)
