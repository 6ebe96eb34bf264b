"""File summaries, device statistics, gaps, and files made redundant by another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions import duration_text, local_text, seconds_between, utc_text
from phasegrid.schema import GAP_SECONDS

# Slots per chunk of a device's time line: the most rows that one ordered window partition sees.
_SLOTS_PER_CHUNK = 4096


def time_range(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """First and last timestamp and the number of rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(column).alias("first_ts"),
        F.max(column).alias("last_ts"),
    )


def file_stats(readings: DataFrame) -> DataFrame:
    """Rows, first and last timestamp per device and file; run it before de-duplication."""
    return time_range(readings.groupBy("device", "file"))


def _slots(readings: DataFrame, threshold_seconds: float, *aggregates) -> DataFrame:
    """First and last timestamp per device and slot of one threshold length.

    Two readings of one slot are less than a threshold apart, so gaps lie between slots only. This
    is a plain partial and final aggregation: however many rows share a device or an instant, they
    are combined before the shuffle, and what follows sees at most one row per slot.
    """
    width = round(threshold_seconds * 1_000_000)
    if width <= 0:
        raise ValueError("The gap threshold must be positive")
    micros = F.unix_micros("timestamp")
    slot = ((micros - F.pmod(micros, F.lit(width))) / width).cast("bigint")
    summary = readings.groupBy("device", slot.alias("slot")).agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), *aggregates
    )
    chunk = F.floor(F.col("slot") / _SLOTS_PER_CHUNK)
    return summary.withColumn("chunk", chunk)


def _previous_slot_end():
    return F.lag("last_ts").over(Window.partitionBy("device", "chunk").orderBy("slot"))


def _previous_chunk_end():
    return F.lag("last_ts").over(Window.partitionBy("device").orderBy("chunk"))


def gaps(readings: DataFrame, threshold_seconds: float = GAP_SECONDS) -> DataFrame:
    """Consecutive readings of a device more than the threshold apart.

    Repeated timestamps do not matter, so no de-duplication is needed first. Order is established
    inside chunks of a device's time line, in parallel, and then between neighbouring chunks.
    """
    slots = _slots(readings, threshold_seconds)
    end = F.col("first_ts").alias("end")
    inside = slots.select("device", _previous_slot_end().alias("start"), end)
    edges = slots.groupBy("device", "chunk").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    between = edges.select("device", _previous_chunk_end().alias("start"), end)
    seconds = seconds_between(F.col("start"), F.col("end"))
    return (
        inside.unionByName(between)
        .where(seconds > threshold_seconds)
        .select(
            "device",
            "start",
            "end",
            (F.col("end") - F.col("start")).alias("duration"),
            seconds.alias("duration_s"),
        )
    )


def device_stats(readings: DataFrame, threshold_seconds: float = GAP_SECONDS) -> DataFrame:
    """Unique rows, first and last timestamp, duration and number of gaps per device.

    Rows count once per timestamp, as after de-duplication. One scan of two columns; each step
    shuffles less than the one before: timestamps, slots, chunks, devices.
    """
    slots = _slots(readings, threshold_seconds, F.count_distinct("timestamp").alias("n"))
    before = _previous_slot_end()
    is_gap = (seconds_between(before, F.col("first_ts")) > threshold_seconds).cast("long")
    chunks = (
        slots.withColumn("gap", F.coalesce(is_gap, F.lit(0)))
        .groupBy("device", "chunk")
        .agg(
            F.sum("n").alias("n"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("gap").alias("gaps"),
        )
    )
    before = _previous_chunk_end()
    is_gap = (seconds_between(before, F.col("first_ts")) > threshold_seconds).cast("long")
    return (
        chunks.withColumn("edge_gap", F.coalesce(is_gap, F.lit(0)))
        .groupBy("device")
        .agg(
            F.sum("n").alias("total_rows"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum(F.col("gaps") + F.col("edge_gap")).alias("n_gaps"),
        )
        .select(
            "device",
            "total_rows",
            "first_ts",
            "last_ts",
            (F.col("last_ts") - F.col("first_ts")).alias("duration"),
            seconds_between(F.col("first_ts"), F.col("last_ts")).alias("duration_s"),
            "n_gaps",
        )
    )


def with_gap_list(stats: DataFrame, found: DataFrame) -> DataFrame:
    """``device_stats`` with each device's gaps, in order, as ``gaps``; a list holds no more than the gap table."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "duration_s"))).alias("gaps")
    lists = found.groupBy(F.col("device").alias("_device")).agg(rows)
    joined = stats.join(lists, F.col("device").eqNullSafe(F.col("_device")), "left").drop("_device")
    return joined.withColumn("gaps", F.coalesce("gaps", F.array().cast(joined.schema["gaps"].dataType)))


def stats_lines(stats: DataFrame, tz: str) -> DataFrame:
    """One readable line per device, with times in ``tz``."""
    # Fixed form of the line.
    line = F.format_string(
        "Device '%s' with %d rows from %s to %s (%s) with %d gaps",
        F.col("device"),
        F.col("total_rows"),
        local_text(F.col("first_ts"), tz),
        local_text(F.col("last_ts"), tz),
        duration_text(F.col("first_ts"), F.col("last_ts")),
        F.col("n_gaps"),
    )
    return stats.select("device", line.alias("line"))


def file_lines(files: DataFrame) -> DataFrame:
    """One readable line per file."""
    # Fixed form of the line.
    line = F.format_string(
        "Device '%s' / %s: %s .. %s (%d rows)",
        F.col("device"),
        F.col("file"),
        utc_text(F.col("first_ts")),
        utc_text(F.col("last_ts")),
        F.col("n_rows"),
    )
    return files.select("device", "file", line.alias("line"))


def duplicate_files(files: DataFrame) -> DataFrame:
    """Files of ``file_stats`` that lie within the time range of their device's leading file.

    The leading file starts first, has most rows among those, and comes first by path. It is found
    by aggregation and joined back, so a device with very many files is not sorted in one task.
    The comparisons are null-safe: Catalyst then derives no filter for one side only, and both sides
    share one scan and one aggregation of the readings.
    """
    lead = F.struct("first_ts", (-F.col("n_rows")).alias("fewest"), "file", "last_ts")
    leading = files.groupBy(F.col("device").alias("_device")).agg(F.min(lead).alias("lead"))
    within = (
        ~F.col("file").eqNullSafe(F.col("lead.file"))
        & (F.col("first_ts") <= F.col("lead.last_ts"))
        & (F.col("last_ts") <= F.col("lead.last_ts"))
    )
    return (
        files.join(leading, F.col("device").eqNullSafe(F.col("_device")))
        .where(F.coalesce(within, F.lit(False)))
        .select(files.columns)
    )
