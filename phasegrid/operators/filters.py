"""Row filters. All are plain comparisons, which Spark can push into a scan that has the column itself."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import parse_age


def _instant(value: dt.datetime | str):
    return F.timestamp_micros(F.lit(epoch_micros(value)))


def epoch_micros(value: dt.datetime | str) -> int:
    """Microseconds since the epoch; naive values are UTC, whatever the time zone of the session."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def between(
    df: DataFrame,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    column: str = "timestamp",
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; either bound may be missing."""
    if start is not None:
        df = df.where(F.col(column) >= _instant(start))
    if end is not None:
        df = df.where(F.col(column) <= _instant(end))
    return df


def in_range(
    df: DataFrame,
    start: dt.datetime | str | None = None,
    stop: dt.datetime | str | None = None,
    column: str = "timestamp",
) -> DataFrame:
    """Rows from ``start`` up to, but not including, ``stop``; either bound may be missing."""
    if start is not None:
        df = df.where(F.col(column) >= _instant(start))
    if stop is not None:
        df = df.where(F.col(column) < _instant(stop))
    return df


def not_older_than(df: DataFrame, age: str, now: dt.datetime, column: str = "timestamp") -> DataFrame:
    """Rows at most ``age`` (``all``, ``max``, ``3w``, ``2d``, ``1h``) older than ``now``."""
    return between(df, start=parse_age(age, now), column=column)


def with_tags(df: DataFrame, **tags: str | Sequence[str]) -> DataFrame:
    """Rows whose tag columns equal the given value, or one of the given values."""
    for name, wanted in tags.items():
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        df = df.where(F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(values))
    return df
