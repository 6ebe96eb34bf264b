"""Column names and Spark schemas of the meter data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and their order as the meters and their consumers spell them.
PHASES = ("a", "b", "c")
MEASURES = (
    "total_act_energy",
    "fund_act_energy",
    "total_act_ret_energy",
    "fund_act_ret_energy",
    "lag_react_energy",
    "lead_react_energy",
    "max_act_power",
    "min_act_power",
    "max_aprt_power",
    "min_aprt_power",
    "max_voltage",
    "min_voltage",
    "avg_voltage",
    "max_current",
    "min_current",
    "avg_current",
)
NEUTRAL_MEASURES = ("max_current", "min_current", "avg_current")
LIVE_FIELDS = ("current", "voltage", "act_power", "aprt_power", "pf", "freq")
TOTAL_FIELDS = ("current", "act_power", "aprt_power")
ERROR_LISTS = ("a_errors", "b_errors", "c_errors", "n_errors", "errors")
MEASUREMENT = "em"
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
RETENTION_WEEKS = 50
GAP_SECONDS = 60

WIDE_MEASURES = tuple(f"{p}_{m}" for p in PHASES for m in MEASURES) + tuple(
    f"n_{m}" for m in NEUTRAL_MEASURES
)
WIDE_COLUMNS = ("timestamp",) + WIDE_MEASURES

# One row per minute as it stands in a CSV file: epoch seconds and 51 doubles.
CSV_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.LongType())]
    + [T.StructField(name, T.DoubleType()) for name in WIDE_MEASURES]
)

POINT_TAGS = ("device", "source", "phase")
POINT_KEY = ("measurement",) + POINT_TAGS + ("ts",)
POINT_FIELDS = MEASURES + LIVE_FIELDS

STAMP = T.DecimalType(38, 0)

# One row per point; a field that a point does not carry is null.
POINT_SCHEMA = T.StructType(
    [
        T.StructField("measurement", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in POINT_FIELDS]
    + [
        T.StructField("written", T.LongType()),
        # Only merged batches carry these: the precedence of each field, that of the batch its value came in.
        T.StructField("stamps", T.StructType([T.StructField(name, STAMP) for name in POINT_FIELDS])),
        T.StructField("source", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("batch", T.StringType()),
    ]
)
POINT_PARTITIONS = ("source", "date", "batch")


def check_measure(name: str) -> str:
    """Return ``name`` if it is a phase measure, otherwise fail while the plan is built."""
    if name not in MEASURES:
        raise ValueError(f"{name!r} is no phase measure; these are: {', '.join(MEASURES)}")
    return name
