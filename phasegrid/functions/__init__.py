"""Column functions. Every one of them is a JVM expression; there are no UDFs."""

from phasegrid.functions.checks import map_strict, one_of, strict_number
from phasegrid.functions.durations import Every, parse_age, parse_every
from phasegrid.functions.labels import device_phase, kwh, number_text
from phasegrid.functions.times import (
    bucket,
    date_of,
    duration_text,
    epoch_micros_to_timestamp,
    epoch_to_timestamp,
    iso_weekday,
    local_text,
    seconds_between,
    utc_text,
    weekday_name,
)

__all__ = [
    "Every",
    "bucket",
    "date_of",
    "device_phase",
    "duration_text",
    "epoch_micros_to_timestamp",
    "epoch_to_timestamp",
    "iso_weekday",
    "kwh",
    "local_text",
    "map_strict",
    "number_text",
    "one_of",
    "parse_age",
    "parse_every",
    "seconds_between",
    "strict_number",
    "utc_text",
    "weekday_name",
]
