"""Joins with checked cardinality, and attachment of device data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The part of its source that a message belongs to.
_PART = "_part"
_SIDES = {"1:1": (True, True), "1:m": (True, False), "m:1": (False, True), "m:m": (False, False)}


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged if no key repeats; a repeated key fails the query.

    The check is one aggregation on ``keys``. Copies of a key are combined in the map tasks, and a
    join on the same keys reuses its partitioning, so the check adds no shuffle to the join.
    """
    # Column by column, so that Spark can hash where all of them have a fixed width.
    row = [F.any_value(c).alias(c) for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *row)
    message = F.concat(F.lit("Key is not unique: "), F.to_json(F.struct(*keys)))
    return once.where(F.assert_true(F.col("_n") == 1, message).isNull()).select(*df.columns)


def join_validated(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    validate: str = "m:m",
) -> DataFrame:
    """Equi-join that fails if a key repeats on a side declared as ``1``."""
    if validate not in _SIDES:
        raise ValueError(f"validate must be one of {sorted(_SIDES)}, not {validate!r}")
    left_unique, right_unique = _SIDES[validate]
    if left_unique:
        left = require_unique(left, on)
    if right_unique:
        right = require_unique(right, on)
    return left.join(right, list(on), how)


def device_lookup(devices: DataFrame) -> DataFrame:
    """``devices`` (src, device), checked to have one row per source, ready to be joined."""
    return require_unique(devices.select("src", "device"), ["src"])


def spread_lookup(lookup: DataFrame, parts: int) -> DataFrame:
    """``lookup`` repeated for each part that ``attach_device_name`` deals the messages of a source out in."""
    return lookup.withColumn(_PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def attach_device_name(messages: DataFrame, lookup: DataFrame, parts: int | None = None, by: Sequence[Column] = ()) -> DataFrame:
    """Add the configured ``device`` name for each ``src``; null for an unknown source.

    ``lookup`` comes from ``device_lookup``. Spark broadcasts it if its statistics say it is small; else
    adaptive execution splits the partition of a busy source. It does not do so in the plan of a stream, where
    a few sources, and all messages without one, would fill a task each: there the lookup is one of
    ``spread_lookup`` and the messages of a source are dealt out in as many ``parts`` by the columns ``by``.
    """
    if parts is None:
        return messages.join(lookup, "src", "left")
    part = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    return messages.withColumn(_PART, part).join(lookup, ["src", _PART], "left").drop(_PART)


def attach_device_info(df: DataFrame, device_info: DataFrame, on: str = "device") -> DataFrame:
    """Add the device-information record as the struct ``device_info``; a device with two records fails."""
    record = F.struct(*[c for c in device_info.columns if c != on])
    lookup = require_unique(device_info.select(on, record.alias("device_info")), [on])
    return df.join(lookup, on, "left")
