"""Wide readings and status messages to phase rows, points, and field values.

Every reshape is one ``stack`` over one scan: no joins and no repeated reads.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import number_text
from phasegrid.schema import (
    LIVE_FIELDS,
    MEASUREMENT,
    MEASURES,
    NEUTRAL_MEASURES,
    PHASES,
    POINT_FIELDS,
    TOTAL_FIELDS,
    check_measure,
)

PHASE_INDEX = ("timestamp", "device", "file")
_NOTHING = "CAST(NULL AS DOUBLE)"


def stack(rows: Sequence[Sequence[str]], names: Sequence[str]) -> str:
    """SQL for one output row per entry of ``rows``, whose cells are SQL expressions.

    One expression text instead of hundreds of column objects: building wide ones is slow.
    """
    cells = ", ".join(cell for row in rows for cell in row)
    return f"stack({len(rows)}, {cells}) AS ({', '.join(names)})"


def phase_column(readings: DataFrame, measure: str, index: Sequence[str] = PHASE_INDEX) -> DataFrame:
    """One row per reading and phase with one measure; nulls stay."""
    check_measure(measure)
    return _phases(readings, [measure], index)


def phase_table(readings: DataFrame, index: Sequence[str] = PHASE_INDEX) -> DataFrame:
    """One row per reading and phase with all 16 measures."""
    return _phases(readings, MEASURES, index)


def _phases(readings: DataFrame, measures: Sequence[str], index: Sequence[str]) -> DataFrame:
    rows = [[f"'{p}'"] + [f"{p}_{m}" for m in measures] for p in PHASES]
    return readings.selectExpr(*index, stack(rows, ["phase", *measures]))


def nest_readings(readings: DataFrame) -> DataFrame:
    """One row per reading with an array of three phase structs and the neutral scalars."""
    structs = [
        f"struct('{p}' AS phase_name, {', '.join(f'{p}_{m} AS {m}' for m in MEASURES)})" for p in PHASES
    ]
    return readings.selectExpr(
        "device", "timestamp", f"array({', '.join(structs)}) AS phases", *[f"n_{m}" for m in NEUTRAL_MEASURES]
    )


def reading_points(readings: DataFrame) -> DataFrame:
    """Four points per reading: three phases and the neutral line."""
    rows = [[f"'{p}'"] + [f"{p}_{m}" for m in MEASURES] for p in PHASES]
    rows.append(["'neutral'"] + [f"n_{m}" if m in NEUTRAL_MEASURES else _NOTHING for m in MEASURES])
    return readings.selectExpr(
        f"'{MEASUREMENT}' AS measurement",
        "device",
        "'csv' AS source",
        "date_trunc('second', timestamp) AS ts",
        stack(rows, ["phase", *MEASURES]),
    ).select("measurement", "device", "source", "phase", "ts", *MEASURES)


def event_points(events: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Three phase points, a neutral point if it was measured, and a total point per event.

    ``events`` has ``device``, ``timestamp`` and the nested ``status``; ``carry`` names further
    columns to keep. Error lists are not part of a point.
    """
    rows = [[f"'{p}'"] + [f"status.phases[{i}].{f}" for f in LIVE_FIELDS] for i, p in enumerate(PHASES)]
    rows.append(["'neutral'"] + ["status.n_current" if f == "current" else _NOTHING for f in LIVE_FIELDS])
    rows.append(["'total'"] + [f"status.total_{f}" if f in TOTAL_FIELDS else _NOTHING for f in LIVE_FIELDS])
    points = events.selectExpr(
        f"'{MEASUREMENT}' AS measurement",
        "device",
        "'live' AS source",
        "date_trunc('second', timestamp) AS ts",
        *carry,
        stack(rows, ["phase", *LIVE_FIELDS]),
    )
    return points.where((F.col("phase") != "neutral") | F.col("current").isNotNull()).select(
        "measurement", "device", "source", "phase", "ts", *LIVE_FIELDS, *carry
    )


def point_fields(points: DataFrame) -> list[str]:
    """The field columns ``points`` has, in schema order."""
    return [f for f in POINT_FIELDS if f in points.columns]


def field_values(points: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per point and field that has a value.

    Naming the ``fields`` a query needs prunes all others from the scan.
    """
    wanted = list(fields) if fields is not None else point_fields(points)
    tags = ["measurement", "device", "source", "phase", "ts"]
    if len(wanted) == 1:
        long = points.selectExpr(*tags, f"'{wanted[0]}' AS field", f"{wanted[0]} AS value")
    else:
        long = points.selectExpr(*tags, stack([[f"'{f}'", f] for f in wanted], ["field", "value"]))
    return long.where(F.col("value").isNotNull())


def line_protocol(points: DataFrame) -> DataFrame:
    """One text line per point: measurement and tags, fields by name, epoch seconds."""
    tags = [
        F.when(F.length(name) > 0, F.concat(F.lit(f"{name}="), _escape(F.col(name), ",= ")))
        for name in ("device", "phase", "source")
    ]
    head = F.concat_ws(",", _escape(F.col("measurement"), ", "), *tags)
    names = sorted(point_fields(points))
    texts = F.concat_ws(",", *[F.concat(F.lit(f"{f}="), number_text(F.col(f))) for f in names])
    # A point without any finite value has no line.
    finite = [F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")) for f in names]
    line = F.concat_ws(" ", head, texts, F.unix_seconds("ts").cast("string"))
    return points.where(reduce(or_, finite)).select(line.alias("line"))


def _escape(col: Column, special: str) -> Column:
    escaped = F.regexp_replace(col, f"([{special}])", r"\\$1")
    for char, text in (("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        escaped = F.replace(escaped, F.lit(char), F.lit(text))
    return escaped
