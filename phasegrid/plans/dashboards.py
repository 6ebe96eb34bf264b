"""The stored dashboard queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from phasegrid.operators.energy import windowed_mean
from phasegrid.operators.filters import with_tags
from phasegrid.operators.reshape import field_values
from phasegrid.schema import MEASUREMENT, PHASES

Instant = dt.datetime | str


def _mean_of(
    points: DataFrame, source: str, field: str, devices: Sequence[str], every, start: Instant, stop: Instant
) -> DataFrame:
    wanted = with_tags(points, measurement=MEASUREMENT, source=source, device=devices, phase=PHASES)
    return windowed_mean(field_values(wanted, [field]), every, start, stop)


def csv_active_energy(
    points: DataFrame, devices: Sequence[str], every: str, start: Instant, stop: Instant
) -> DataFrame:
    """Mean active energy of imported readings per device, phase and window."""
    return _mean_of(points, "csv", "total_act_energy", devices, every, start, stop)


def live_active_power(
    points: DataFrame, devices: Sequence[str], every: str, start: Instant, stop: Instant
) -> DataFrame:
    """Mean active power of live notifications per device, phase and window."""
    return _mean_of(points, "live", "act_power", devices, every, start, stop)
