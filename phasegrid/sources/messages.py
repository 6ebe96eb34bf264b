"""JSON documents at rest or arriving in a landing folder, one document per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Recorded documents as the column ``value``; parse them with ``operators.messages``."""
    return spark.read.text(path)


def message_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None, max_bytes_per_trigger: str | None = None
) -> DataFrame:
    """A stream over the same files, for all devices at once; either bound limits what a batch takes in.

    Any other streaming source with a text column ``value`` serves as well.
    """
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.text(path)
