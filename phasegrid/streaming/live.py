"""Live ingest: notifications to stored points, and a windowed mean over the stream."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phasegrid.operators.filters import with_tags
from phasegrid.operators.joins import attach_device_name, device_lookup, spread_lookup
from phasegrid.operators.messages import parse_messages
from phasegrid.operators.reshape import event_points
from phasegrid.schema import POINT_KEY
from phasegrid.sinks.outcomes import record_outcome
from phasegrid.sinks.points import WriteOutcome, compact_points, now_micros, write_points
from phasegrid.sources.points import MERGED, latest_points

FLUSH_INTERVAL = "1 second"
#: Parts in which the messages of a source meet their device where the lookup is too large to be broadcast.
SOURCE_PARTS = 32
#: Types of columns by which messages are dealt out.
_HASHED = ("string", "bigint", "int", "timestamp")


def parse_events(raw: DataFrame, devices: DataFrame, text: str = "value") -> DataFrame:
    """Parsed notifications with their ``device``; works on batches and streams alike.

    A message from a source that is not in ``devices`` becomes an error row.
    """
    return _parse(raw.withColumnRenamed(text, "value"), _lookup(devices))


def _lookup(devices: DataFrame) -> DataFrame:
    """The device of each source, and the source's place among those of its device, for each part of the source."""
    rank = F.row_number().over(Window.partitionBy("device").orderBy("src"))
    return spread_lookup(device_lookup(devices).withColumn("source_rank", rank), SOURCE_PARTS)


def _parse(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    plain = [F.col(f"`{c}`") for c, kind in raw.dtypes if kind.split("(")[0] in _HASHED]
    events = attach_device_name(parse_messages(raw), lookup, SOURCE_PARTS, plain)
    unknown = (F.col("route") == "status") & F.col("device").isNull()
    return events.withColumn(
        "error", F.when(unknown, F.concat(F.lit("unknown source "), "src")).otherwise(F.col("error"))
    ).withColumn("route", F.when(unknown, F.lit("error")).otherwise(F.col("route")))


def live_points(raw: DataFrame, devices: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Points of all accepted notifications; ``carry`` may name ``event``, the order of the events."""
    events = parse_events(raw, devices).where("route = 'status'").withColumn("event", _event_order())
    return event_points(events, carry=list(carry)) if carry else event_points(events)


def _event_order() -> Column:
    """Time of an event, then its source, as one number of fixed width, so that aggregations can hash."""
    micros = F.unix_micros("timestamp").cast("decimal(20,0)")
    return (micros * F.lit(10**10).cast("decimal(11,0)") + F.col("source_rank")).cast("decimal(38,0)")


def batch_points(events: DataFrame) -> DataFrame:
    """Points of one batch, one per series and second: the latest event wins, then the later source."""
    return latest_points(event_points(events.withColumn("event", _event_order()), carry=["event"]), "event")


def stream_identity(spark: SparkSession, checkpoint: str) -> str:
    """The name Spark gave the stream in its checkpoint; it stays over restarts and no other stream has it."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]


def write_live(
    raw: DataFrame,
    devices: DataFrame,
    path: str,
    dead_letters: str,
    checkpoint: str,
    trigger: dict | None = None,
    on_batch: Callable[[DataFrame, WriteOutcome], None] | None = None,
    on_failure: Callable[[WriteOutcome], None] | None = None,
    outcomes: str | None = None,
    merge_every: int | None = None,
) -> StreamingQuery:
    """Start the live pipeline.

    Points go to the store at ``path`` under the stream's own name and the micro-batch number, so a
    batch that is repeated after a failure replaces itself and no other stream's. Messages that
    cannot be processed go to ``dead_letters`` with the reason and stop nothing. ``on_batch`` sees
    each batch of accepted events; ``on_failure`` sees a batch that could not be stored, before the
    stream ends with the error. ``devices`` is read again for each batch.

    How often points are flushed is the ``trigger``'s part, how many at once the source's
    (``message_stream``'s bounds). After every ``merge_every`` batches the stream merges the folders of its
    own finished batches, so their number per day stays small. ``outcomes`` names a table of what became of
    each attempt (``sinks.read_outcomes``).
    """
    known: dict[str, str] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, written = batch.sparkSession, now_micros()
        first = "stream" not in known
        if first:
            known["stream"] = stream_identity(spark, checkpoint)
        name = f"live-{known['stream']}-{batch_id}"
        lookup = _lookup(devices).persist()
        events = _parse(batch, lookup)
        try:
            # Once it is held Spark knows how small it is, so that the join need not shuffle the messages.
            lookup.count()
            events.persist()
            accepted = events.where("route = 'status'")
            counted = Observation()
            seen = accepted.observe(counted, F.count(F.lit(1)).alias("rows"))
            # Only the first batch after a start may have been tried before.
            outcome = write_points(batch_points(seen), path, name, written, replace=first, counted=counted)
            (
                events.where("route = 'error'")
                .select("value", "error", F.lit(name).alias("batch"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch")
                .parquet(dead_letters)
            )
            if on_batch is not None:
                on_batch(accepted, outcome)
            if merge_every is not None and batch_id and batch_id % merge_every == 0:
                own = f"live-{known['stream']}-"
                # The present batch may be tried again under its name; those before it are done.
                compact_points(spark, path, dt.date.max, of=lambda b: b != name and b.startswith((own, f"{MERGED}-{own}")), name=own)
            if outcomes is not None:
                record_outcome(spark, outcomes, outcome)
        except Exception as error:
            failed = WriteOutcome(name, 0, None, 0.0, str(error))
            if outcomes is not None:
                record_outcome(spark, outcomes, failed)
            if on_failure is not None:
                on_failure(failed)
            raise
        finally:
            events.unpersist()
            lookup.unpersist()

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": FLUSH_INTERVAL})).start()


def stream_seconds(
    raw: DataFrame,
    devices: DataFrame,
    field: str,
    late: str,
    device: str | Sequence[str] | None = None,
    phase: str | Sequence[str] | None = None,
) -> DataFrame:
    """One field of a stream of notifications, one value per series and second, for update mode.

    As in the store, the latest event of a second counts; a second comes again with each batch that changes
    it. The state holds one value and its event per series and second, not older than ``late``; events later
    than that may be left out.
    """
    points = live_points(raw, devices, carry=["event"]).withWatermark("ts", late)
    tags = {name: value for name, value in (("device", device), ("phase", phase)) if value is not None}
    values = with_tags(points, **tags).where(F.col(field).isNotNull())
    latest = values.groupBy(*POINT_KEY).agg(F.max_by(field, "event").alias("value"), F.max("event").alias("event"))
    return latest.select(*POINT_KEY, F.lit(field).alias("field"), "value", "event")


def write_seconds(seconds: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep every version of the values of ``stream_seconds`` below ``path``; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = seconds.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": FLUSH_INTERVAL})).start()


def read_windowed_mean(spark: SparkSession, path: str, every: str) -> DataFrame:
    """Mean per series and window of what ``write_seconds`` stored, open windows included.

    Windows are ``every`` long in Spark's interval syntax and carry their end. Both stages are hash
    aggregations: the latest value of each second, then the mean of the seconds of each window.
    """
    series = ["measurement", "device", "source", "phase", "field"]
    seconds = spark.read.parquet(path).groupBy(*series, "ts").agg(F.max_by("value", "event").alias("value"))
    means = seconds.groupBy(*series, F.window("ts", every)).agg(F.avg("value").alias("value"))
    return means.select(*series, F.col("window.end").alias("time"), "value")


def stop(query: StreamingQuery, timeout: int = 60) -> bool:
    """Stop a query and wait for it; the checkpoint lets it resume later."""
    query.stop()
    return query.awaitTermination(timeout)
