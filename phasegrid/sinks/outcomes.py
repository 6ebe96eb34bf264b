"""A table of what became of each attempt to write a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.sinks.points import WriteOutcome, now_micros

_SCHEMA = "batch string, points long, rows long, seconds double, error string, at long"


def record_outcome(spark: SparkSession, path: str, outcome: WriteOutcome) -> None:
    """Append one attempt; an attempt that failed carries its error."""
    row = (outcome.batch, outcome.points, outcome.rows, float(outcome.seconds), outcome.error, now_micros())
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """batch, attempt, outcome, points, rows, seconds, error: all attempts, numbered within their batch.

    ``outcome`` is ``success`` for a first attempt that stored its points, ``retry`` for a later one
    that did, ``error`` for any that failed.
    """
    attempts = spark.read.schema(_SCHEMA).parquet(path)
    attempt = F.row_number().over(Window.partitionBy("batch").orderBy("at"))
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("attempt") > 1, "retry").otherwise("success")
    return attempts.withColumn("attempt", attempt).select(
        "batch", "attempt", outcome.alias("outcome"), "points", "rows", "seconds", "error"
    )
