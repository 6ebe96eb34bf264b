"""Intermediate tables in the folder all executors share, and row numbers without a global window."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.session import scratch_dir

_SEQUENCE_BITS = 33
#: Where each written table lies.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, safe against lost executors."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list, name: str, purpose: str) -> DataFrame:
    """``df``, written, with its 0-based place in the given order as ``name``.

    Rows are dealt out by range and counted per range; only the counts, one row per range, meet in
    one place. Rows that are equal in ``order`` get places next to each other.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(ranged.withColumn("__place", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("__place", _SEQUENCE_BITS)
    return with_places(table, part, F.col("__place").bitwiseAND((1 << _SEQUENCE_BITS) - 1), F.lit(1), name).drop("__place")


def with_places(table: DataFrame, part, sequence, size, name: str) -> DataFrame:
    """Add the running total of ``size`` over all earlier parts, plus ``sequence`` within the part."""
    totals = table.groupBy(part.alias("__part")).agg(F.sum(size).alias("__size"))
    before = totals.selectExpr(
        "__part", "coalesce(sum(__size) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before"
    )
    joined = table.withColumn("__part", part).join(before, "__part")
    return joined.withColumn(name, F.col("__before") + sequence).drop("__part", "__before")
