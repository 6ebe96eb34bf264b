"""Casts and look-ups that fail the query on a value outside their domain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("null"))


def one_of(col: Column, allowed: Sequence[str]) -> Column:
    """``col`` unchanged; a non-null value outside ``allowed`` is an error."""
    return F.when(col.isNull() | col.isin(*allowed), col).otherwise(
        F.raise_error(F.concat(F.lit("Value outside its domain: "), _text(col)))
    )


def map_strict(col: Column, mapping: Mapping) -> Column:
    """Replace every value by its entry in ``mapping``; a value without an entry is an error."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(entries, col)
    return F.when(found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("No mapping for value: "), _text(col)))
    )


def strict_number(col: Column) -> Column:
    """Text to double; anything that is not a number, an empty or missing value too, is an error."""
    number = col.try_cast("double")
    return F.when(number.isNotNull(), number).otherwise(
        F.raise_error(F.concat(F.lit("Not a number: "), _text(col)))
    )
