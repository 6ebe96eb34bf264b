"""Import of CSV folders into the point store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from phasegrid.operators.dedup import dedup
from phasegrid.operators.reshape import reading_points
from phasegrid.session import configure
from phasegrid.sinks.outcomes import record_outcome
from phasegrid.sinks.points import WriteOutcome, ensure_table, new_batch, now_micros, write_points
from phasegrid.sources.csv import DeviceSource, load_readings


def import_csv(
    spark: SparkSession,
    sources: Sequence[DeviceSource],
    path: str,
    batch: str | None = None,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    outcomes: str | None = None,
    table: str | None = None,
) -> WriteOutcome:
    """Read strictly, keep the last row per device and timestamp, write four points per row.

    The import is a new batch of the store unless ``batch`` names one to replace. A device whose
    folder holds no files is left out; if none holds any, nothing is written. ``start`` and ``end``
    bound the readings that are imported. ``outcomes`` names a table in which what became of the import
    is recorded, a failure too; ``table`` a registered table to bring in step with the store.
    """
    configure(spark)
    written = now_micros()
    name = batch or new_batch("import")
    try:
        rows = load_readings(spark, sources, strict=True, start=start, end=end, missing="skip")
        if rows is None:
            return WriteOutcome(batch or "", 0, 0, 0.0)
        counted = Observation()
        readings = dedup(rows, keep="last").observe(counted, F.count(F.lit(1)).alias("rows"))
        outcome = write_points(reading_points(readings), path, name, written, replace=batch is not None, counted=counted)
    except Exception as error:
        if outcomes is not None:
            record_outcome(spark, outcomes, WriteOutcome(name, 0, None, 0.0, str(error)))
        raise
    if outcomes is not None:
        record_outcome(spark, outcomes, outcome)
    if table is not None:
        ensure_table(spark, table, path)
    return outcome
