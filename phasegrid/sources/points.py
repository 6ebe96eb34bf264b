"""Reading the point store."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.operators.filters import epoch_micros, in_range
from phasegrid.operators.reshape import point_fields
from phasegrid.schema import POINT_FIELDS, POINT_KEY, POINT_SCHEMA, STAMP

#: Batches of this name hold one row per point: merging wrote them.
MERGED = "compacted"
#: Stored points that one task merges; a point takes up to 2 kB of its memory.
POINTS_PER_TASK = 100_000
#: Distance of two instants in a stamp; the hash of a batch's name lies in between.
_INSTANT = Decimal(2 * 10**19)


def point_log(spark: SparkSession, path: str) -> DataFrame:
    """All stored points, repeated writes included."""
    return spark.read.schema(POINT_SCHEMA).parquet(path)


def batch_stamp() -> Column:
    """The precedence of a batch as one number of fixed width: when it began, then its name."""
    return (F.col("written").cast("decimal(18,0)") * F.lit(_INSTANT) + F.xxhash64("batch")).cast(STAMP)


def field_stamp(field: str) -> Column:
    """The precedence of one field of a stored point, null where the point does not carry it."""
    return F.when(F.col(field).isNotNull(), F.coalesce(F.col("stamps")[field], batch_stamp()))


def dealt_points(log: DataFrame) -> DataFrame:
    """The stored points dealt out so that a task merges a bounded number of them, however many there are.

    The rows are counted for it, which opens no column but those ``log`` is filtered by. A batch holds a point once, so map
    tasks would combine next to nothing and hold all they read for it.
    """
    tasks = -(-log.count() // POINTS_PER_TASK)
    return log.repartition(max(1, tasks), *POINT_KEY)


def latest_points(points: DataFrame, order: Column | str | None = None) -> DataFrame:
    """One row per series and second; each field has its latest non-null value.

    Without ``order``, points of the store are ordered by their stamps, field by field. With ``order`` of
    fixed width, as a stamp is, this is one hash aggregation with map-side combining.
    """
    fields = point_fields(points)
    if order is None and "stamps" in points.columns:
        orders = {f: field_stamp(f) for f in fields}
    else:
        position = order if isinstance(order, Column) else F.col(order or "written")
        orders = {f: F.when(F.col(f).isNotNull(), position) for f in fields}
    ordered = points.select(*POINT_KEY, *fields, *[c.alias(f"_order_{f}") for f, c in orders.items()])
    return ordered.groupBy(*POINT_KEY).agg(*[F.max_by(f, f"_order_{f}").alias(f) for f in fields])


def read_points(
    spark: SparkSession,
    path: str,
    start: dt.datetime | str | None = None,
    stop: dt.datetime | str | None = None,
    fields: Sequence[str] = POINT_FIELDS,
) -> DataFrame:
    """Current points in ``[start, stop)`` that have any of ``fields``, reading only those; either bound may be missing.

    Each bound is repeated as a bound of the ``date`` partition column, so that Spark skips the
    folders outside it. Days that hold one merged batch and nothing else are read as they stand; only
    the others are merged, which takes a shuffle (``dealt_points``).
    """
    log = in_range(point_log(spark, path), start, stop, column="ts")
    if start is not None:
        log = log.where(F.col("date") >= F.lit(_day(start)))
    if stop is not None:
        log = log.where(F.col("date") <= F.lit(_day(stop)))
    # The log has listed its files already: a batch that comes from now on is in neither part.
    settled, others = _settled(spark, path, start, stop)
    columns = [*POINT_KEY, *fields]
    held = reduce(or_, [F.col(f).isNotNull() for f in fields])
    stamped = [*columns, "written", "batch", "stamps"]
    if not settled:
        return latest_points(dealt_points(log).where(held).select(*stamped))
    done = reduce(or_, [(F.col("source") == s) & F.col("date").isin(days) for s, days in settled.items()])
    plain = log.where(done).where(held).select(*columns)
    if not others:
        return plain
    return plain.unionByName(latest_points(dealt_points(log.where(~done)).where(held).select(*stamped)))


def _settled(
    spark: SparkSession, path: str, start: dt.datetime | str | None, stop: dt.datetime | str | None
) -> tuple[dict[str, list[dt.date]], bool]:
    """By source, the days of the range that hold one merged batch only; and whether there are others.

    Folder names tell it: no file is opened, and what is kept are days, not batches.
    """
    found: dict[str, list[dt.date]] = defaultdict(list)
    first, last = (None if v is None else _day(v) for v in (start, stop))
    others = False
    for source_folder, source in _folders(spark, path, "source"):
        for day_folder, text in _folders(spark, source_folder, "date"):
            day = dt.date.fromisoformat(text)
            if (first is not None and day < first) or (last is not None and day > last):
                continue
            names = [name for _, name in _folders(spark, day_folder, "batch")]
            if len(names) == 1 and names[0].startswith(f"{MERGED}-"):
                found[source].append(day)
            else:
                others |= bool(names)
    return dict(found), others


def _folders(spark: SparkSession, path: str, partition: str) -> list[tuple[str, str]]:
    """(folder, value) of the partition folders right below ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [str(s.getPath().toString()) for s in system.listStatus(where) if s.getPath().getName().startswith(f"{partition}=")]
    return [(n, unquote(n.rsplit("=", 1)[1])) for n in names]


def _day(value: dt.datetime | str) -> dt.date:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=epoch_micros(value))).date()
