"""A table of what running streams report: rows in, time taken and state of each batch, and how runs end."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)

_SCHEMA = (
    "query string, run string, name string, event string, batch long, input_rows long, batch_ms long, "
    "state_rows long, late_rows long, error string, at timestamp"
)
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


class StreamMetrics(StreamingQueryListener):
    """Appends the events of all streams of a session to the table at ``path``.

    ``spark.streams.addListener(metrics)`` starts it. Rows are held until there are ``flush_rows`` of them or a
    run ends, so that a stream of short batches does not make a file for each. Spark hands events over after
    the batch, on a thread of their own: they slow no stream, and a failing write here ends none.
    """

    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 500):
        self.spark, self.path, self.flush_rows = spark, path, flush_rows
        self._held: list[tuple] = []
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._note(event.id, event.runId, event.name, "started", at=event.timestamp)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        state = [(s.numRowsTotal, s.numRowsDroppedByWatermark) for s in p.stateOperators]
        self._note(
            p.id, p.runId, p.name, "batch", p.batchId, p.numInputRows, p.batchDuration,
            sum(s[0] for s in state), sum(s[1] for s in state), at=p.timestamp,
        )

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._note(event.id, event.runId, None, "ended" if event.exception is None else "failed", error=event.exception)
        try:
            self.flush()
        finally:
            with self._changed:
                self._ended.add(str(event.runId))
                self._changed.notify_all()

    def _note(self, query, run, name, event, batch=None, rows=None, ms=None, state=None, late=None, error=None, at=None) -> None:
        with self._changed:
            self._held.append((str(query), str(run), name, event, batch, rows, ms, state, late, error, at))
            full = len(self._held) >= self.flush_rows
        if full:
            self.flush()

    def flush(self) -> None:
        """Write the rows that are held; if that fails they stay for the next time."""
        with self._changed:
            rows, self._held = self._held, []
        if not rows:
            return
        try:
            texts = self.spark.createDataFrame(rows, _SCHEMA.replace("at timestamp", "at string"))
            table = texts.withColumn("at", F.coalesce(F.to_timestamp("at"), F.current_timestamp()))
            table.select(*_COLUMNS).coalesce(1).write.mode("append").parquet(self.path)
        except Exception:
            with self._changed:
                self._held = rows + self._held
            raise

    def finished(self, query: StreamingQuery, timeout: float = 60) -> bool:
        """Wait until all that a stopped or failed query told is in the table."""
        until, run = time.monotonic() + timeout, str(query.runId)
        with self._changed:
            return self._changed.wait_for(lambda: run in self._ended, max(0.0, until - time.monotonic()))


def read_stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: batches with rows, their rows, longest and mean time, largest state, how it ended.

    ``outcome`` is ``running`` for a run that has not told of its end.
    """
    events = spark.read.schema(_SCHEMA).parquet(path)
    batch = (F.col("event") == "batch") & (F.col("input_rows") > 0)
    runs = events.groupBy("query", "run").agg(
        F.max("name").alias("name"),
        F.min("at").alias("started"),
        F.count_if(batch).alias("batches"),
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.max(F.when(batch, F.col("batch_ms"))).alias("longest_ms"),
        F.avg(F.when(batch, F.col("batch_ms"))).alias("mean_ms"),
        F.max("state_rows").alias("state_rows"),
        F.sum("late_rows").alias("late_rows"),
        F.max(F.when(F.col("event").isin("ended", "failed"), F.col("event"))).alias("outcome"),
        F.max("error").alias("error"),
    )
    return runs.withColumn("outcome", F.coalesce("outcome", F.lit("running")))
