"""Energy sums over tumbling windows, weekday profile, windowed mean per series."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import Every, bucket, date_of, iso_weekday, kwh, parse_every, weekday_name
from phasegrid.operators.filters import _instant, in_range
from phasegrid.operators.reshape import stack
from phasegrid.schema import PHASES, WEEKDAYS

_ENERGY = "total_act_energy"
_GROUPS = ("device", "phase", "file")


def energy_sums(readings: DataFrame, keys: Sequence[Column | str], by_phase: bool) -> DataFrame:
    """Sum of active energy per ``keys``, as one column ``energy``, 0 where nothing was measured.

    The three phase columns are summed side by side and only the result is turned into phase rows,
    so the aggregation reads, shuffles and hashes each reading once instead of three times.
    """
    sums = [F.coalesce(F.sum(f"{p}_{_ENERGY}"), F.lit(0.0)).alias(f"_{p}") for p in PHASES]
    summed = readings.groupBy(*keys).agg(*sums)
    kept = [c for c in summed.columns if c not in {f"_{p}" for p in PHASES}]
    if by_phase:
        rows = [[f"'{p}'", f"_{p}"] for p in PHASES]
        return summed.selectExpr(*kept, stack(rows, ["phase", "energy"]))
    return summed.select(*kept, (F.col("_a") + F.col("_b") + F.col("_c")).alias("energy"))


def total_energy(
    readings: DataFrame,
    every: str | dt.timedelta,
    group_by: Sequence[str] | None = ("device", "phase"),
    start_by: str = "window",
    keep_window_start: bool = False,
    tz: str | None = None,
    origin_rows: DataFrame | None = None,
) -> DataFrame:
    """Energy in kWh per window of length ``every`` and group.

    ``group_by`` is any selection of device, phase and file; ``None`` sums over everything.
    ``start_by`` is ``window``, ``datapoint`` (windows are counted from each group's first reading)
    or a weekday name (from the last such day before it). Windows without readings are absent. The
    result carries the date of the window start, and the start itself with ``keep_window_start``.

    ``origin_rows`` may give the rows before de-duplication: each device has the same first reading
    there, and finding it needs no second de-duplication.
    """
    groups = list(group_by or ())
    unknown = [g for g in groups if g not in _GROUPS]
    if unknown:
        raise ValueError(f"Cannot group by {unknown}. Use any of {list(_GROUPS)}")
    length = parse_every(every)
    keys = [g for g in groups if g != "phase"]
    needed = readings.select("timestamp", *keys, *[f"{p}_{_ENERGY}" for p in PHASES])
    origins = origin_rows if origin_rows is not None and "file" not in keys else needed
    needed, start = _with_start(needed, origins, length, keys, start_by.lower(), tz)
    sums = energy_sums(needed, [*keys, start.alias("window_start")], "phase" in groups)
    local_start = F.col("window_start")
    if tz is not None:
        local_start = F.from_utc_timestamp(local_start, tz)
    columns = [*groups, date_of(local_start).alias("date"), kwh(F.col("energy")).alias(f"{_ENERGY}_kwh")]
    if keep_window_start:
        columns.insert(len(groups), F.col("window_start"))
    return sums.select(*columns)


def _with_start(
    df: DataFrame, origins: DataFrame, length: Every, keys: Sequence[str], start_by: str, tz: str | None
) -> tuple[DataFrame, Column]:
    ts = F.col("timestamp")
    if start_by == "window":
        return df, bucket(ts, length, tz=tz)
    weekdays = [d.lower() for d in WEEKDAYS]
    if start_by not in ("datapoint", *weekdays):
        raise ValueError(f"start_by must be 'window', 'datapoint' or a weekday, not {start_by!r}")
    one_week = length.weekly and length.micros == 7 * 86_400_000_000
    if start_by in weekdays and one_week:
        return df, bucket(ts, length, shift_days=weekdays.index(start_by), tz=tz)
    first = F.min("timestamp").alias("_origin")
    if keys:
        df = df.join(origins.groupBy(*keys).agg(first), list(keys))
    else:
        df = df.withColumn("_origin", origins.agg(first).scalar())
    origin = F.col("_origin")
    if start_by in weekdays:
        origin = bucket(origin, "1w", shift_days=weekdays.index(start_by), tz=tz)
    return df, bucket(ts, length, origin=origin, tz=tz)


def energy_per_timestamp(readings: DataFrame) -> DataFrame:
    """Active energy (Wh) of all devices and phases per timestamp."""
    return energy_sums(readings, ["timestamp"], by_phase=False).withColumnRenamed("energy", _ENERGY)


def daily_total_energy(readings: DataFrame) -> DataFrame:
    """Energy in kWh per device, phase and UTC day."""
    return total_energy(readings, "1d")


def weekday_energy(readings: DataFrame) -> DataFrame:
    """Mean daily energy (kWh) per weekday, device and phase, over the days that have readings."""
    number = "day_of_week_num"
    daily = daily_total_energy(readings).withColumn(number, iso_weekday(F.col("date")))
    mean = daily.groupBy(number, "device", "phase").agg(
        F.avg(f"{_ENERGY}_kwh").alias(f"{_ENERGY}_kwh")
    )
    return mean.withColumn("day_of_week", weekday_name(F.col(number)))


def windowed_mean(
    values: DataFrame,
    every: str | dt.timedelta,
    start: dt.datetime | str,
    stop: dt.datetime | str,
) -> DataFrame:
    """Mean value per series and window over ``[start, stop)``, labelled with the window's end.

    Windows are counted from the epoch; the first and the last are cut at the range. Empty windows
    are absent.
    """
    length = parse_every(every)
    series = ["measurement", "device", "source", "phase", "field"]
    window = bucket(F.col("ts"), length, weeks_from_epoch=True)
    mean = (
        in_range(values, start, stop, column="ts")
        .groupBy(*series, window.alias("_window"))
        .agg(F.avg("value").alias("value"))
    )
    step = F.make_ym_interval(F.lit(0), F.lit(length.months)) if length.months else None
    end = (
        F.col("_window") + step
        if step is not None
        else F.timestamp_micros(F.unix_micros("_window") + length.micros)
    )
    return mean.select(*series, F.least(end, _instant(stop)).alias("time"), "value")
