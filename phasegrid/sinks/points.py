"""The point store: Parquet partitioned by source, date and batch.

A batch is named by its writer and a number of the writer's own, so writers never meet in a folder.
A batch that is written again under its name replaces all it held. Which of several values of a point
counts is told by the batch's stamp: the time ``written`` at which it began, then its name. The later one
wins, field by field (``sources.latest_points``). Compaction keeps each value with the stamp of the batch it
came in, so a batch that began before the compaction and ends after it, or takes part in the next one, has
the same place among the others as without any compaction. A batch holds a point once.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import date_of
from phasegrid.operators.filters import between, epoch_micros
from phasegrid.operators.reshape import point_fields
from phasegrid.schema import POINT_KEY, POINT_PARTITIONS, POINT_SCHEMA, RETENTION_WEEKS
from phasegrid.sources.points import MERGED, dealt_points, field_stamp


@dataclass(frozen=True)
class WriteOutcome:
    """What one write did: points stored, readings or events they came from (if counted), or the error."""

    batch: str
    points: int
    rows: int | None
    seconds: float
    error: str | None = None


def ensure_table(spark: SparkSession, name: str, path: str) -> bool:
    """Register the point store as a table if it is missing and bring its partitions in step with the folders.

    Folders that writes added become partitions, and partitions whose folders compaction or retention
    removed go. Tells whether the table was created.
    """
    created = not spark.catalog.tableExists(name)
    if created:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in POINT_SCHEMA.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"PARTITIONED BY ({', '.join(POINT_PARTITIONS)}) LOCATION '{path}'"
        )
    if _files(spark, path)[1]:
        spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    return created


def new_batch(writer: str) -> str:
    """A batch name that no other write has."""
    return f"{writer}-{uuid.uuid4().hex}"


def now_micros() -> int:
    return time.time_ns() // 1000


def write_points(
    points: DataFrame,
    path: str,
    batch: str | None = None,
    written: int | None = None,
    replace: bool = True,
    counted: Observation | None = None,
) -> WriteOutcome:
    """Write ``points`` as one batch and report how many they were.

    A named batch replaces what it held before; ``replace=False`` saves looking for that where the
    name is known to be new. ``written`` is when the batch began, by default now; merged points bring
    their own stamps.
    ``counted`` is an observation with a metric ``rows`` on what the points came from.

    The rebalance step lets Spark size the files of each partition folder at run time: a folder with
    very many points is split over several tasks and small ones share a task. Rows are sorted by
    series within a file, which keeps row groups selective and compresses the tags.
    """
    spark = points.sparkSession
    named, batch = batch is not None, batch or new_batch("batch")
    observed = Observation()
    if "stamps" not in points.columns:
        points = points.withColumn("written", F.lit(now_micros() if written is None else written).cast("bigint"))
    stored = (
        points.withColumn("date", date_of(F.col("ts")))
        .withColumn("batch", F.lit(batch))
        .hint("rebalance", "source", "date")
        .observe(observed, F.count(F.lit(1)).alias("points"))
        .sortWithinPartitions("source", "date", "device", "phase", "ts")
    )
    started = time.monotonic()
    if named and replace:
        # A failure between removal and write leaves the batch missing until it is written again.
        _remove(spark, path, [folder for *_, found, folder in batch_folders(spark, path) if found == batch])
    stored.write.mode("append").partitionBy(*POINT_PARTITIONS).parquet(path)
    rows = None if counted is None else _metric(counted, "rows")
    return WriteOutcome(batch, _metric(observed, "points"), rows, time.monotonic() - started)


def _merged(log: DataFrame) -> DataFrame:
    """One row per point, each field with its latest value and that value's stamp."""
    fields = point_fields(log)
    ordered = dealt_points(log).select(*POINT_KEY, "written", *fields, *[field_stamp(f).alias(f"_stamp_{f}") for f in fields])
    grouped = ordered.groupBy(*POINT_KEY).agg(
        F.max("written").alias("written"),
        *[F.max_by(f, f"_stamp_{f}").alias(f) for f in fields],
        *[F.max(f"_stamp_{f}").alias(f"_stamp_{f}") for f in fields],
    )
    stamps = F.struct(*[F.col(f"_stamp_{f}").alias(f) for f in fields]).alias("stamps")
    return grouped.select(*POINT_KEY, *fields, "written", stamps)


def _metric(observed: Observation, name: str) -> int:
    try:
        return observed.get[name]
    except Py4JJavaError:
        # Spark drops the observed node from a plan it knows to be empty; then there are no metrics.
        return 0


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.exists(where)


def batch_folders(spark: SparkSession, path: str) -> list[tuple[str, str, str, str]]:
    """(source, date, batch, folder) of every folder of the store; names only, no data is read."""
    files, there = _files(spark, path)
    if not there:
        return []
    pattern = "/".join([path.rstrip("/"), *[f"{p}=*" for p in POINT_PARTITIONS]])
    folders = [s.getPath() for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern))]
    parts = [(p, [unquote(x.split("=", 1)[1]) for x in str(p.toString()).rsplit("/", 3)[1:]]) for p in folders]
    return [(*names, str(p.toString())) for p, names in parts]


def _remove(spark: SparkSession, path: str, folders: list[str]) -> None:
    files, _ = _files(spark, path)
    for folder in folders:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def retained(points: DataFrame, now: dt.datetime, weeks: int = RETENTION_WEEKS) -> DataFrame:
    """Points that are not older than the retention period."""
    return between(points, start=now - dt.timedelta(weeks=weeks), column="ts")


def compact_points(
    spark: SparkSession,
    path: str,
    before: dt.date,
    now: dt.datetime | None = None,
    weeks: int = RETENTION_WEEKS,
    of: Callable[[str], bool] | None = None,
    table: str | None = None,
    name: str = "",
) -> WriteOutcome | None:
    """Merge the batches of each closed day, a day before ``before``, into one; with ``now``, drop what is past retention.

    Only days with more than one batch, and days that retention touches, are read; ``of`` narrows the
    batches that are merged by their name. The merged batch is written first and the folders it replaces
    are removed afterwards, so a failure loses nothing: until then both are there and tell the same.
    ``table`` names a registered table to bring in step; ``name`` goes into the merged batch's own.
    """
    days: dict[tuple[str, str], list[str]] = {}
    for source, date, batch, folder in batch_folders(spark, path):
        if of is None or of(batch):
            days.setdefault((source, date), []).append(folder)
    oldest = None if now is None else now - dt.timedelta(weeks=weeks)
    edge = None if oldest is None else str(_utc_day(oldest))
    old = [f for (_, date), folders in days.items() if edge is not None and date < edge for f in folders]
    _remove(spark, path, old)
    merged = [
        f
        for (_, date), folders in days.items()
        if date < str(before) and (edge is None or date >= edge) and (len(folders) > 1 or date == edge)
        for f in folders
    ]
    outcome = None
    if merged:
        log = spark.read.schema(POINT_SCHEMA).option("basePath", path).parquet(*merged)
        if oldest is not None:
            log = between(log, start=oldest, column="ts")
        outcome = write_points(_merged(log), path, new_batch(f"{MERGED}-{name}" if name else MERGED), replace=False)
        _remove(spark, path, merged)
    if table is not None:
        ensure_table(spark, table, path)
    return outcome


def _utc_day(value: dt.datetime) -> dt.date:
    return (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=epoch_micros(value))).date()


def write_lines(lines: DataFrame, path: str) -> None:
    """Write text lines, one file per task."""
    lines.write.mode("overwrite").text(path)
