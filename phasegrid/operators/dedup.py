"""De-duplication and import counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup(
    readings: DataFrame,
    keep: str = "first",
    keys: Sequence[str] = ("device", "timestamp"),
    order: Sequence[str] = ("file", "pos"),
) -> DataFrame:
    """One row per key: the first or the last in file-path order, then by position in the file.

    A ranking filter rather than an aggregate over the whole row, for two reasons: columns nobody
    reads are pruned from the scan and the shuffle, and Spark applies the ``= 1`` limit in every
    map task first, so even a key with a huge number of copies sends one row per task.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    ordering = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering))
    return readings.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def import_counts(readings: DataFrame) -> DataFrame:
    """Total rows, unique rows and files per device.

    Both distinct counts come from an aggregation of their own with map-side combining; no row is
    multiplied to count two things at once.
    """
    by_time = readings.groupBy("device", "timestamp").agg(F.count(F.lit(1)).alias("n"))
    rows = by_time.groupBy("device").agg(
        F.sum("n").alias("total_rows"), F.count_if(F.col("timestamp").isNotNull()).alias("unique_rows")
    )
    by_file = readings.groupBy("device", "file").agg(F.count(F.lit(1)).alias("n"))
    files = by_file.groupBy(F.col("device").alias("_device")).agg(F.count("file").alias("n_files"))
    return rows.join(files, F.col("device").eqNullSafe(F.col("_device"))).drop("_device")
