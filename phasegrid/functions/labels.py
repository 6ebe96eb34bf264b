"""Labels, unit scaling and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def device_phase(device: Column, phase: Column) -> Column:
    """``<device>_<phase>``; null if either part is null."""
    return F.concat(device, F.lit("_"), phase)


def kwh(watt_hours: Column) -> Column:
    # A product, not a quotient: the two can differ in the last bit.
    return watt_hours * F.lit(0.001)


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double: plain from 1e-4 up to 1e16, else with an exponent.

    Whole numbers have no fraction. NaN and infinities give null. The digits are the JVM's: before
    Java 19 it writes one digit more than needed for a few numbers of extreme size, which still
    read back as the same double.
    """
    text = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(
        F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d*?)0+$", "$1"),
        r"\.$",
        "",
    )
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.when(exponent < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(exponent))
    )
    return (
        F.when(text.endswith(".0"), F.left(text, F.length(text) - 2))
        .when(F.isnan(value) | (size == float("inf")), F.lit(None).cast("string"))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
