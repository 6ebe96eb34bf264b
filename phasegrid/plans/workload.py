"""The registered queries: every operator on the driver tables, over all their rows.

The tables hold no meter data, so readings, points and messages are derived from ``events`` (and,
for volume, from ``lineitem``) by plain projections.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.functions import (
    device_phase,
    epoch_micros_to_timestamp,
    iso_weekday,
    local_text,
    number_text,
    one_of,
    strict_number,
    weekday_name,
)
from phasegrid.operators import dedup as dd
from phasegrid.operators import energy, filters, joins, messages, quality, reshape
from phasegrid.plans.analysis import MeterData
from phasegrid.plans.dashboards import csv_active_energy, live_active_power
from phasegrid.plans.imports import import_csv
from phasegrid.schema import LIVE_FIELDS, MEASURES, NEUTRAL_MEASURES, PHASES, WIDE_COLUMNS
from phasegrid.session import configure, scratch_dir
from phasegrid.sinks import compact_points, ensure_table, read_outcomes, record_outcome, retained, write_lines, write_points
from phasegrid.sources import DeviceSource, latest_points, load_readings, message_stream, point_log, read_points
from phasegrid.streaming import (
    StreamMetrics,
    live,
    read_stream_metrics,
    read_windowed_mean,
    stream_seconds,
    write_live,
    write_seconds,
)

NOW = dt.datetime(2024, 1, 31)
START, STOP = "2024-01-05 07:30:00", "2024-01-20 16:45:00"
ZONE = "Europe/Berlin"
#: Retention seen from here goes back to the start of 2024-01-16.
NOON_OF_RETENTION = dt.datetime(2024, 12, 31)
DEVICES = ("dev0", "dev1", "dev2")
ERROR = "'error'"
PHASE_SCALE = {"a": 1.0, "b": 0.5, "c": 0.25}

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as wide readings: 3 devices, 5 files, repeated minutes, some missing values."""
    measures = []
    for p, scale in PHASE_SCALE.items():
        for i, m in enumerate(MEASURES):
            product = f"value * {scale * (i + 1)}D"
            measures.append(f"{f'IF(event_type <> {ERROR}, {product}, NULL)' if p == 'c' else product} AS {p}_{m}")
    for i, m in enumerate(NEUTRAL_MEASURES):
        measures.append(f"IF(event_type <> {ERROR}, value * {0.125 * (i + 1)}D, NULL) AS n_{m}")
    return table(spark, sf_dir, "events").selectExpr(
        "date_trunc('minute', CAST(ts AS TIMESTAMP)) AS timestamp",
        *measures,
        "concat('dev', CAST(user_id % 3 AS STRING)) AS device",
        "event_type AS file",
        "event_id AS pos",
    )


def _device() -> Column:
    return F.concat(F.lit("dev"), (F.col("user_id") % 3).cast("string"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as readings with energy columns only: the volume test."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_quantity").alias("a_total_act_energy"),
        F.col("l_extendedprice").alias("b_total_act_energy"),
        F.col("l_discount").alias("c_total_act_energy"),
        F.col("l_returnflag").alias("device"),
        F.col("l_linestatus").alias("file"),
        F.struct("l_orderkey", "l_linenumber").alias("pos"),
    )


def _meter_document(skip: str | None = None, extra: list[Column] = ()) -> Column:
    value = F.col("value")
    fields = {"id": F.lit(0)}
    for p, scale in PHASE_SCALE.items():
        for i, f in enumerate(LIVE_FIELDS):
            fields[f"{p}_{f}"] = value * (scale * (i + 1))
    fields["n_current"] = F.when(F.col("event_type") == "click", value * 0.125)
    fields["total_current"] = value * 1.75
    fields["total_act_power"] = value * 5.25
    fields["total_aprt_power"] = value * 7.0
    return F.struct(*[c.alias(k) for k, c in fields.items() if k != skip], *extra)


def status_messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` as notification texts: status, other kinds, and four kinds of faulty messages."""
    kind, fault = F.col("event_type"), F.col("user_id") % 4
    ts = (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)")
    src = F.when(F.col("user_id") % 50 == 49, F.lit("stranger")).otherwise(
        F.concat(F.lit("meter-"), (F.col("user_id") % 3).cast("string"))
    )

    def text(method: str, *params: Column) -> Column:
        body = F.struct(
            src.alias("src"), F.lit("client").alias("dst"), F.lit(method).alias("method"),
            F.struct(ts.alias("ts"), *params).alias("params"),
        )
        return F.to_json(body, {"ignoreNullFields": "false"})

    whole = _meter_document().alias("em:0")
    lacking = _meter_document("total_current").alias("em:0")
    surplus = _meter_document(extra=[F.lit(1).alias("surplus")]).alias("em:0")
    message = (
        F.when(kind.isin("view", "click"), text("NotifyStatus", whole))
        .when(kind == "signup", text("NotifyStatus"))
        .when(kind == "purchase", text("NotifyEvent"))
        .when(fault == 0, text("NotifyFullStatus", whole))
        .when(fault == 1, text("NotifyStatus", lacking))
        .when(fault == 2, text("NotifyStatus", surplus))
        .otherwise(F.concat(F.lit("{broken "), F.col("event_id").cast("string")))
    )
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select("event_id", message.alias("value"))


def _half_of_messages(spark: SparkSession, sf_dir: str, half: int) -> DataFrame:
    """The messages of every second event in three parts. Events are dealt out, not texts, which Spark sorts for it."""
    events = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == half)
    return status_messages(spark, sf_dir, events.select("event_id", "ts", "user_id", "event_type", "value").repartition(3))


def device_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"meter-{i}", d) for i, d in enumerate(DEVICES)], "src string, device string")


def plain(df: DataFrame, **digits: int) -> DataFrame:
    """For comparison: zone-free timestamps, no intervals, doubles rounded where sum order matters."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            columns.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif name in digits:
            columns.append(F.round(name, digits[name]).alias(name))
        elif not kind.startswith("interval"):
            columns.append(F.col(f"`{name}`"))
    return df.select(*columns)


def first_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup(readings(spark, sf_dir))


def _energy(every: str, group_by=("device", "phase"), **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = energy.total_energy(
            first_readings(spark, sf_dir), every, group_by, keep_window_start=True,
            origin_rows=readings(spark, sf_dir), **options
        )
        return plain(result, total_act_energy_kwh=9)

    return query


def _shipped_energy(every: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = energy.total_energy(shipments(spark, sf_dir), every, keep_window_start=True)
        return plain(result, total_act_energy_kwh=5)

    return query


def _dedup(source, keep: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dd.dedup(source(spark, sf_dir), keep)
        if dict(rows.dtypes)["pos"].startswith("struct"):
            rows = rows.select("*", "pos.*").drop("pos")
        return plain(rows)

    return query


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.reading_points(first_readings(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "points")
    write_points(_points(spark, sf_dir), path)
    return path


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.parse_events(status_messages(spark, sf_dir), device_names(spark))


def _message_folder(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "messages")
    write_lines(status_messages(spark, sf_dir).select("value"), path)
    return path


def import_counts(spark, sf_dir):
    return dd.import_counts(readings(spark, sf_dir))


def phase_column(spark, sf_dir):
    return plain(reshape.phase_column(readings(spark, sf_dir), "total_act_energy"))


def phase_all(spark, sf_dir):
    return plain(reshape.phase_table(readings(spark, sf_dir)))


def nested_readings(spark, sf_dir):
    nested = reshape.nest_readings(readings(spark, sf_dir))
    phases = F.col("phases")
    return plain(
        nested.select(
            "device", "timestamp", F.size("phases").alias("n_phases"),
            *[phases[i][m].alias(f"{p}_{m}") for i, p in enumerate(PHASES) for m in MEASURES],
            *[f"n_{m}" for m in NEUTRAL_MEASURES],
        )
    )


def energy_weekday(spark, sf_dir):
    return plain(energy.weekday_energy(first_readings(spark, sf_dir)), total_act_energy_kwh=9)


def energy_per_timestamp(spark, sf_dir):
    return plain(energy.energy_per_timestamp(first_readings(spark, sf_dir)), total_act_energy=6)


def energy_since_age(spark, sf_dir):
    rows = filters.not_older_than(readings(spark, sf_dir), "2w", NOW)
    return plain(energy.daily_total_energy(dd.dedup(rows)), total_act_energy_kwh=9)


def energy_range(spark, sf_dir):
    rows = filters.between(readings(spark, sf_dir), START, STOP)
    return plain(energy.daily_total_energy(dd.dedup(rows)), total_act_energy_kwh=9)


def time_range(spark, sf_dir):
    return plain(quality.time_range(readings(spark, sf_dir)))


def file_stats(spark, sf_dir):
    return plain(quality.file_stats(readings(spark, sf_dir)))


def device_stats(spark, sf_dir):
    return plain(quality.device_stats(readings(spark, sf_dir), 3600))


def device_stats_shipments(spark, sf_dir):
    return plain(quality.device_stats(shipments(spark, sf_dir), 86_400))


def stats_line(spark, sf_dir):
    return quality.stats_lines(quality.device_stats(readings(spark, sf_dir), 3600), ZONE)


def file_line(spark, sf_dir):
    return quality.file_lines(quality.file_stats(readings(spark, sf_dir)))


def gaps(spark, sf_dir):
    return plain(quality.gaps(readings(spark, sf_dir), 3600))


def gaps_minute(spark, sf_dir):
    return plain(quality.gaps(readings(spark, sf_dir)))


def gaps_shipments(spark, sf_dir):
    return plain(quality.gaps(shipments(spark, sf_dir), 86_400))


def duplicate_files(spark, sf_dir):
    return plain(quality.duplicate_files(quality.file_stats(readings(spark, sf_dir))))


def duplicate_files_many(spark, sf_dir):
    """Every user's events of one type are a file: thousands of files on three devices."""
    source = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        _device().alias("device"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type")).alias("file"),
    )
    return plain(quality.duplicate_files(quality.file_stats(source)))


def _labelled(spark, sf_dir):
    daily = energy.daily_total_energy(first_readings(spark, sf_dir))
    return daily.withColumn("device_phase", device_phase(F.col("device"), F.col("phase")))


def device_phase_label(spark, sf_dir):
    return plain(_labelled(spark, sf_dir).drop("device", "phase"), total_act_energy_kwh=9)


def top_days(spark, sf_dir):
    rounded = plain(_labelled(spark, sf_dir), total_act_energy_kwh=9)
    order = [F.col("total_act_energy_kwh").desc(), "device_phase", "date"]
    return rounded.orderBy(*order).limit(10)


def points_csv(spark, sf_dir):
    return plain(_points(spark, sf_dir))


def points_long(spark, sf_dir):
    return plain(reshape.field_values(_points(spark, sf_dir)))


def line_protocol(spark, sf_dir):
    return reshape.line_protocol(_points(spark, sf_dir))


def line_protocol_file(spark, sf_dir):
    path = scratch_dir(spark, "lines")
    write_lines(line_protocol(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def points_table(spark, sf_dir):
    return plain(reshape.field_values(read_points(spark, _stored(spark, sf_dir))))


def _doubled(points: DataFrame) -> DataFrame:
    return points.select(*[(F.col(c) * 2).alias(c) if c in MEASURES else F.col(c) for c in points.columns])


def points_compacted(spark, sf_dir):
    """Two batches over the same points, the second with doubled values for phase a and neutral, merged."""
    path = _stored(spark, sf_dir)
    write_points(_doubled(_points(spark, sf_dir).where("phase IN ('a', 'neutral')")), path)
    compact_points(spark, path, dt.date(2100, 1, 1))
    return plain(reshape.field_values(read_points(spark, path)))


def store_two_streams(spark, sf_dir):
    """Two streams with checkpoints of their own write the messages of different devices into one store."""
    path = scratch_dir(spark, "stream")
    for part in (0, 1):
        folder = scratch_dir(spark, "messages")
        mine = (F.coalesce(F.get_json_object("value", "$.src"), F.lit("")) == "meter-1") == bool(part)
        write_lines(status_messages(spark, sf_dir).select("value").where(mine), folder)
        _run_stream(spark, folder, path, f"{path}-{part}")
    return plain(reshape.field_values(read_points(spark, path), LIVE_FIELDS))


def store_compact_then_stream(spark, sf_dir):
    """A stream writes, the store is compacted, the same stream goes on with its next micro-batches."""
    folder, path = scratch_dir(spark, "messages"), scratch_dir(spark, "stream")
    late = F.col("event_id") % 3 == 0
    messages = status_messages(spark, sf_dir)
    messages.where(~late).select("value").write.mode("append").text(folder)
    _run_stream(spark, folder, path, path)
    compact_points(spark, path, dt.date(2100, 1, 1))
    messages.where(late).select("value").write.mode("append").text(folder)
    _run_stream(spark, folder, path, path)
    return plain(reshape.field_values(read_points(spark, path), LIVE_FIELDS))


def store_rewrite_fewer_days(spark, sf_dir):
    """A batch is written again under its name with the first half of its time only."""
    path = scratch_dir(spark, "points")
    points = _points(spark, sf_dir)
    write_points(points, path, "import-1")
    write_points(points.where("ts < TIMESTAMP '2024-01-16 00:00:00'"), path, "import-1")
    return plain(reshape.field_values(read_points(spark, path)))


def store_open_range(spark, sf_dir):
    """Points from a start on, without an end."""
    return plain(reshape.field_values(read_points(spark, _stored(spark, sf_dir), start="2024-01-16")))


def points_registered(spark, sf_dir):
    """The store read through its registered table, before and after a second batch, compaction and retention.

    The table's partitions are told beside the points: they are those of the folders.
    """
    path = _stored(spark, sf_dir)
    name = f"points_{path.rsplit('-', 1)[-1]}"
    ensure_table(spark, name, path)
    write_points(_points(spark, sf_dir), path)
    compact_points(spark, path, dt.date(2100, 1, 1), now=NOON_OF_RETENTION, table=name)
    days = spark.sql(f"SHOW PARTITIONS {name}").select(F.regexp_extract("partition", "date=([^/]*)", 1).alias("day"))
    counted = days.groupBy("day").agg(F.count(F.lit(1)).alias("partitions"))
    points = reshape.field_values(latest_points(spark.table(name)))
    return plain(points.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(counted, "day", "left").drop("day"))


def retention(spark, sf_dir):
    return plain(retained(_points(spark, sf_dir), NOW + dt.timedelta(days=335)))


def windowed_mean(spark, sf_dir):
    result = csv_active_energy(_points(spark, sf_dir), DEVICES[:2], "6h", START, STOP)
    return plain(result, value=6)


def windowed_mean_stored(spark, sf_dir):
    points = read_points(spark, _stored(spark, sf_dir), START, STOP, ["total_act_energy"])
    return plain(csv_active_energy(points, DEVICES[:2], "1w", START, STOP), value=6)


def windowed_mean_live(spark, sf_dir):
    points = live.batch_points(_parsed(spark, sf_dir).where("route = 'status'"))
    return plain(live_active_power(points, DEVICES, "1h", START, STOP), value=6)


def join_validated(spark, sf_dir):
    rows = first_readings(spark, sf_dir)
    keys = ["timestamp", "device", "file", "phase"]
    left = reshape.phase_column(rows, "total_act_energy")
    right = reshape.phase_column(rows, "max_voltage")
    return plain(joins.join_validated(left, right, keys, "left", "1:1"))


def device_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("src"))
    devices = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("src"), F.col("c_name").alias("device")
    )
    return joins.attach_device_name(events, joins.device_lookup(devices))


def device_info_join(spark, sf_dir):
    info = messages.parse_device_info(device_documents(spark, sf_dir)).select("device", "info.*")
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("device"))
    joined = joins.attach_device_info(events, info)
    return joined.select("event_id", "device", F.col("device_info.name").alias("name"), F.col("device_info.gen").alias("gen"))


def messages_routed(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "route", "error")


def messages_typed(spark, sf_dir):
    status = F.col("status")
    return plain(
        _parsed(spark, sf_dir).where("route = 'status'").select(
            "event_id", "src", "device", "timestamp", status["n_current"].alias("n_current"),
            status["phases"][1]["voltage"].alias("b_voltage"),
            F.size(status["errors"]).alias("n_errors"),
            status["total_act_power"].alias("total_act_power"),
        )
    )


def messages_points(spark, sf_dir):
    points = live.live_points(status_messages(spark, sf_dir), device_names(spark))
    return plain(reshape.field_values(points))


def points_latest(spark, sf_dir):
    points = live.batch_points(_parsed(spark, sf_dir).where("route = 'status'"))
    return plain(reshape.field_values(points))


def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as device status documents; ``error`` events lack a system field."""
    value, number = F.col("value"), F.col("event_id")
    system = {
        key: (number + i if kind == "bigint" else (F.col("user_id") % 2 == 0) if kind == "boolean"
              else F.concat(F.lit(f"{key}-"), F.col("user_id").cast("string")))
        for i, (key, kind) in enumerate(messages.SYSTEM_FIELDS.items())
    }

    def text(skip: str | None) -> Column:
        parts = {
            messages.TEMPERATURE_KEY: F.struct(F.lit(0).alias("id"), (value * 0.5).alias("tC")),
            "sys": F.struct(*[c.alias(k) for k, c in system.items() if k != skip]),
            messages.METER_KEY: _meter_document(
                extra=[F.array().cast("array<string>").alias(messages.CALIBRATION)]
            ),
            messages.METER_DATA_KEY: F.struct(
                F.lit(0).alias("id"),
                *[(value * (i + 1.0)).alias(k) for i, k in enumerate(messages.METER_DATA_FIELDS[1:])],
            ),
        }
        return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), {"ignoreNullFields": "false"})

    document = F.when(F.col("event_type") == "error", text("uptime")).otherwise(text(None))
    return table(spark, sf_dir, "events").select("event_id", document.alias("value"))


def snapshots(spark, sf_dir):
    parsed = messages.parse_snapshots(snapshot_documents(spark, sf_dir))
    return messages.flatten_snapshots(parsed, keep=["event_id"])


def _part(spark, sf_dir, path: str) -> DataFrame:
    documents = snapshot_documents(spark, sf_dir)
    return documents.select("event_id", F.get_json_object("value", path).alias("value"))


def system_status(spark, sf_dir):
    rows = messages.parse_system_status(_part(spark, sf_dir, "$.sys"))
    return rows.select("event_id", "error", *[F.col(f"sys.{f}").alias(f) for f in ("mac", "unixtime", "uptime")])


def meter_status(spark, sf_dir):
    em = messages.parse_meter_status(_part(spark, sf_dir, "$['em:0']"))
    return plain(em.select("event_id", "error", "em.n_current", *[f"em.total_{f}" for f in ("current", "act_power", "aprt_power")]))


def meter_counters(spark, sf_dir):
    rows = messages.parse_meter_counters(_part(spark, sf_dir, "$['emdata:0']"))
    return plain(rows.select("event_id", "error", *[F.col(f"emdata.{f}").alias(f) for f in messages.METER_DATA_FIELDS[1:]]))


def gap_lists(spark, sf_dir):
    rows = readings(spark, sf_dir)
    stats = quality.with_gap_list(quality.device_stats(rows, 3600), quality.gaps(rows, 3600))
    listed = stats.select("device", "n_gaps", F.posexplode_outer("gaps").alias("place", "gap"))
    listed = listed.withColumn("place", F.col("place").cast("long"))
    return plain(listed.select("device", "n_gaps", "place", "gap.start", "gap.end"))


def energy_local_hours(spark, sf_dir):
    """Hours do not depend on the zone; only the date of a window does."""
    rows = first_readings(spark, sf_dir)
    return plain(energy.total_energy(rows, "1h", ("device",), tz=ZONE, keep_window_start=True), total_act_energy_kwh=9)


def snapshots_rejected(spark, sf_dir):
    parsed = messages.parse_snapshots(snapshot_documents(spark, sf_dir))
    return parsed.where("error IS NOT NULL").select("event_id", "error")


def device_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as device information records."""
    key, name = F.col("c_custkey"), F.col("c_name")
    fields = {
        k: (key + i if kind == "bigint" else (key % 2 == 0) if kind == "boolean"
            else F.lit(None).cast("string") if k == "auth_domain" else name)
        for i, (k, kind) in enumerate(messages.DEVICE_INFO_FIELDS.items())
    }
    text = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "customer").select(key.alias("device"), text.alias("value"))


def device_info(spark, sf_dir):
    parsed = messages.parse_device_info(device_documents(spark, sf_dir))
    return parsed.select("device", "error", "info.*")


def record_blocks(spark, sf_dir):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))

    def block(shift: int) -> Column:
        return F.struct(
            (start + shift).alias("ts"), F.lit(60).alias("period"), (F.col("o_custkey") % 1440).alias("records")
        )

    document = F.to_json(F.struct(F.array(block(0), block(86_400)).alias("data_blocks")))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", document.alias("value"))
    return plain(messages.parse_record_blocks(raw).select("o_orderkey", "ts", "period", "records", "timestamp"))


def scalar_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    exact = (F.unix_micros(ts).cast("decimal(20,0)") / 1_000_000).cast("decimal(20,6)")
    day = F.to_date(ts)
    return plain(
        table(spark, sf_dir, "events").select(
            "event_id",
            epoch_micros_to_timestamp(exact.cast("string")).alias("from_text"),
            iso_weekday(day).alias("weekday_num"),
            weekday_name(iso_weekday(day)).alias("weekday"),
            local_text(ts, ZONE).alias("local_time"),
            number_text(F.col("value") * 1e-5).alias("small_text"),
            number_text(F.col("value") * 1e6).alias("large_text"),
            one_of(F.col("event_type"), ["view", "click", "error", "purchase", "signup"]).alias("kind"),
            strict_number(F.col("value").cast("string")).alias("number"),
        )
    )


def _csv_sources(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> list[DeviceSource]:
    path = scratch_dir(spark, "csv")
    rows = first_readings(spark, sf_dir) if rows is None else rows
    rows = rows.na.fill(0.0).select(
        F.unix_seconds("timestamp").alias("timestamp"), *WIDE_COLUMNS[1:], "device"
    )
    rows.write.partitionBy("device").option("header", True).csv(path)
    return [DeviceSource(f"{path}/device={d}", d) for d in DEVICES]


def _overlapping_sources(spark: SparkSession, sf_dir: str) -> list[DeviceSource]:
    """Two files per device that hold all its readings between them, those of even minutes twice.

    The second file, later by name, has its columns in reverse order and twice the values.
    """
    path = scratch_dir(spark, "csv")
    rows = first_readings(spark, sf_dir).na.fill(0.0).select(
        F.unix_seconds("timestamp").alias("timestamp"), *WIDE_COLUMNS[1:], "device"
    )
    minute = (F.col("timestamp") / 60).cast("bigint")
    both = minute % 2 == 0
    twice = [(F.col(c) * 2).alias(c) for c in WIDE_COLUMNS[1:]]
    first = rows.where(both | (minute % 4 == 1))
    first.write.partitionBy("device").option("header", True).csv(f"{path}/a")
    second = rows.where(both | (minute % 4 == 3)).select("timestamp", *twice, "device")
    second.select(*reversed(second.columns)).write.partitionBy("device").option("header", True).csv(f"{path}/b")
    return [DeviceSource(f"{path}/{part}/device={d}", d) for d in DEVICES for part in "ab"]


def csv_roundtrip(spark, sf_dir):
    rows = load_readings(spark, _csv_sources(spark, sf_dir), strict=True)
    return plain(rows.drop("file", "pos"))


def csv_analysis(spark, sf_dir):
    """Overlapping files with different headers: the first file of a device that has a timestamp counts."""
    data = MeterData.load(spark, _overlapping_sources(spark, sf_dir))
    which = F.regexp_extract("file", "/([ab])/[^/]*/[^/]*$", 1)
    return plain(data.readings.withColumn("file", which))


def csv_bad_cell(spark, sf_dir):
    """Every ``error`` reading has a text among its values: these are set aside, the energy of the others is summed."""
    path = scratch_dir(spark, "csv")
    rows = first_readings(spark, sf_dir).na.fill(0.0)
    faulty = F.col("file") == "error"
    cells = {
        "b_max_voltage": F.when(faulty, F.lit("n/a")).otherwise(F.col("b_max_voltage").cast("string")),
        "n_avg_current": F.when(faulty & (F.unix_seconds("timestamp") % 120 == 0), F.lit("-")).otherwise(F.col("n_avg_current").cast("string")),
    }
    rows.withColumns(cells).select(F.unix_seconds("timestamp").alias("timestamp"), *WIDE_COLUMNS[1:], "device").write.partitionBy(
        "device"
    ).option("header", True).csv(path)
    data = MeterData.load(spark, [DeviceSource(f"{path}/device={d}", d) for d in DEVICES], set_aside=True)
    second = F.timestamp_seconds(F.split_part("line", F.lit(","), F.lit(1)).cast("bigint"))
    rejected = data.rejected.select("device", second.alias("timestamp"), F.array_join("columns", " ").alias("columns"), F.lit(None).cast("double").alias("kwh"))
    daily = data.total_energy("1d", ("device",), keep_window_start=True)
    kept = daily.select("device", F.col("window_start").alias("timestamp"), F.lit(None).cast("string").alias("columns"), F.col("total_act_energy_kwh").alias("kwh"))
    return plain(rejected.unionByName(kept), kwh=9)


def weekday_ordered(spark, sf_dir):
    """The weekday profile in its order: each row with its place in the sorted frame."""
    data = MeterData(readings(spark, sf_dir))
    placed = data.total_energy_by_day_of_week().withColumn("_place", F.monotonically_increasing_id())
    # A week's profile has seven rows a series; numbering it takes one small window.
    place = F.row_number().over(Window.orderBy("_place"))
    return plain(placed.withColumn("place", place).drop("_place"), total_act_energy_kwh=9)


def csv_keep_last(spark, sf_dir):
    path = scratch_dir(spark, "imported")
    import_csv(spark, _overlapping_sources(spark, sf_dir), path)
    return plain(reshape.field_values(read_points(spark, path)))


def csv_range(spark, sf_dir):
    """The energy of a time range, read from CSV with the range in the scan."""
    data = MeterData.load(spark, _csv_sources(spark, sf_dir), start=START, end=STOP)
    return plain(data.total_energy("1d").drop("window_start"), total_act_energy_kwh=9)


def csv_import(spark, sf_dir):
    path = scratch_dir(spark, "imported")
    import_csv(spark, _csv_sources(spark, sf_dir), path)
    return plain(reshape.field_values(read_points(spark, path)))


def _run_stream(spark: SparkSession, folder: str, path: str, checkpoint: str) -> None:
    query = write_live(
        message_stream(spark, folder), device_names(spark), path, f"{path}-rejected", f"{checkpoint}-checkpoint",
        trigger={"availableNow": True},
    )
    query.awaitTermination()


def stream_points(spark, sf_dir):
    folder, path = _message_folder(spark, sf_dir), scratch_dir(spark, "stream")
    _run_stream(spark, folder, path, path)
    return plain(reshape.field_values(read_points(spark, path), LIVE_FIELDS))


def stream_rejected(spark, sf_dir):
    folder, path = _message_folder(spark, sf_dir), scratch_dir(spark, "stream")
    _run_stream(spark, folder, path, path)
    rejected = spark.read.parquet(f"{path}-rejected")
    return rejected.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def stream_mean(spark, sf_dir):
    folder, path = _message_folder(spark, sf_dir), scratch_dir(spark, "means")
    seconds = stream_seconds(message_stream(spark, folder), device_names(spark), "act_power", "1 hour", phase=PHASES)
    write_seconds(seconds, path, f"{path}-checkpoint", {"availableNow": True}).awaitTermination()
    return plain(read_windowed_mean(spark, path, "6 hours"), value=9)


def stream_flushed(spark, sf_dir):
    """A stream under a processing-time trigger, bounded to a file a batch, stopped and started again between files.

    Every second batch it merges the folders of the batches before. The days are told with the points: none
    is left with more than the merged folder and those of two batches.
    """
    folder, path = scratch_dir(spark, "messages"), scratch_dir(spark, "stream")
    for half in (0, 1):
        _half_of_messages(spark, sf_dir, half).select("value").write.mode("append").text(folder)
        query = write_live(
            message_stream(spark, folder, max_files_per_trigger=1), device_names(spark), path, f"{path}-rejected", f"{path}-checkpoint",
            trigger={"processingTime": "100 milliseconds"}, merge_every=2, outcomes=f"{path}-outcomes",
        )
        query.processAllAvailable()
        live.stop(query)
    batches = read_outcomes(spark, f"{path}-outcomes").where("outcome = 'success'").count()
    folders = point_log(spark, path).groupBy("date").agg(F.countDistinct("batch").alias("n")).agg(F.max("n").alias("n"))
    points = reshape.field_values(read_points(spark, path), LIVE_FIELDS).groupBy("measurement", "device", "source", "phase", "ts", "field").agg(F.count(F.lit(1)).alias("n"))
    return plain(points.withColumns({"merged": F.lit(folders.first()[0] <= 3), "batches": F.lit(batches >= 6)}))


def write_outcomes(spark, sf_dir):
    """What became of three batches: one stored, one whose first attempt failed, one stored twice under its name."""
    folder, path = scratch_dir(spark, "messages"), scratch_dir(spark, "stream")
    write_lines(status_messages(spark, sf_dir).select("value"), folder)
    told = f"{path}-outcomes"

    def run(on_batch=None) -> None:
        query = write_live(
            message_stream(spark, folder), device_names(spark), path, f"{path}-rejected", f"{path}-checkpoint",
            trigger={"availableNow": True}, outcomes=told, on_batch=on_batch,
        )
        query.awaitTermination()

    def broken(events: DataFrame, outcome) -> None:
        raise RuntimeError("no room left")

    try:
        run(broken)
    except StreamingQueryException:
        run()
    points = _points(spark, sf_dir)
    for _ in range(2):
        record_outcome(spark, told, write_points(points, path, "import-1"))
    record_outcome(spark, told, write_points(points.where("phase = 'a'"), path, "import-2"))
    kind = F.when(F.col("batch").startswith("live-"), "live").otherwise(F.col("batch"))
    error = F.when(F.col("error").contains("no room left"), "no room left")
    return read_outcomes(spark, told).select(kind.alias("batch"), "attempt", "outcome", "points", "rows", error.alias("error"))


def stream_metrics(spark, sf_dir):
    """What two runs of a live stream report: the first fails in its batch, the second repeats it and ends."""
    folder, path = scratch_dir(spark, "messages"), scratch_dir(spark, "stream")
    write_lines(status_messages(spark, sf_dir).select("value"), folder)
    metrics = StreamMetrics(spark, f"{path}-metrics")
    spark.streams.addListener(metrics)

    def broken(events: DataFrame, outcome) -> None:
        raise RuntimeError("no room left")

    try:
        for on_batch in (broken, None):
            query = write_live(
                message_stream(spark, folder), device_names(spark), path, f"{path}-rejected", f"{path}-checkpoint",
                trigger={"availableNow": True}, on_batch=on_batch,
            )
            try:
                query.awaitTermination()
            except StreamingQueryException:
                pass
            if not metrics.finished(query):
                raise TimeoutError("the stream did not tell of its end")
    finally:
        spark.streams.removeListener(metrics)
    told = read_stream_metrics(spark, f"{path}-metrics")
    error = F.when(F.col("error").contains("no room left"), "no room left")
    return told.select("outcome", "batches", "input_rows", (F.col("longest_ms") > 0).alias("timed"), error.alias("error"))


QUERIES: dict[str, Query] = {
    "energy_daily": _energy("1d"),
    "energy_hourly": _energy("1h"),
    "energy_weekly": _energy("1w"),
    "energy_monthly": _energy("1mo"),
    "energy_quarterly": _energy("1q"),
    "energy_two_weeks": _energy("2w"),
    "energy_grand_total": _energy("1d", None),
    "energy_by_device": _energy("1d", ("device",)),
    "energy_by_phase": _energy("1d", ("phase",)),
    "energy_by_file": _energy("1w", ("file", "device", "phase")),
    "energy_start_thursday": _energy("1w", start_by="thursday"),
    "energy_from_datapoint": _energy("5h", start_by="datapoint"),
    "energy_from_datapoint_all": _energy("7h", None, start_by="datapoint"),
    "energy_local_days": _energy("1d", tz=ZONE),
    "energy_shipments_monthly": _shipped_energy("1mo"),
    "energy_shipments_weekly": _shipped_energy("1w"),
    "energy_weekday": energy_weekday,
    "weekday_ordered": weekday_ordered,
    "energy_per_timestamp": energy_per_timestamp,
    "energy_since_age": energy_since_age,
    "energy_range": energy_range,
    "dedup_first": _dedup(readings, "first"),
    "dedup_last": _dedup(readings, "last"),
    "dedup_shipments": _dedup(shipments, "first"),
    "import_counts": import_counts,
    "phase_column": phase_column,
    "phase_all": phase_all,
    "nested_readings": nested_readings,
    "time_range": time_range,
    "file_stats": file_stats,
    "device_stats": device_stats,
    "device_stats_shipments": device_stats_shipments,
    "stats_line": stats_line,
    "file_line": file_line,
    "gaps": gaps,
    "gaps_minute": gaps_minute,
    "gaps_shipments": gaps_shipments,
    "duplicate_files": duplicate_files,
    "duplicate_files_many": duplicate_files_many,
    "device_phase_label": device_phase_label,
    "top_days": top_days,
    "points_csv": points_csv,
    "points_long": points_long,
    "line_protocol": line_protocol,
    "line_protocol_file": line_protocol_file,
    "points_table": points_table,
    "points_compacted": points_compacted,
    "points_registered": points_registered,
    "store_open_range": store_open_range,
    "store_rewrite_fewer_days": store_rewrite_fewer_days,
    "store_compact_then_stream": store_compact_then_stream,
    "store_two_streams": store_two_streams,
    "points_latest": points_latest,
    "retention": retention,
    "windowed_mean": windowed_mean,
    "windowed_mean_stored": windowed_mean_stored,
    "windowed_mean_live": windowed_mean_live,
    "join_validated": join_validated,
    "device_join": device_join,
    "device_info_join": device_info_join,
    "messages_routed": messages_routed,
    "messages_typed": messages_typed,
    "messages_points": messages_points,
    "snapshots": snapshots,
    "snapshots_rejected": snapshots_rejected,
    "system_status": system_status,
    "meter_status": meter_status,
    "meter_counters": meter_counters,
    "gap_lists": gap_lists,
    "energy_local_hours": energy_local_hours,
    "device_info": device_info,
    "record_blocks": record_blocks,
    "scalar_functions": scalar_functions,
    "csv_roundtrip": csv_roundtrip,
    "csv_import": csv_import,
    "csv_range": csv_range,
    "csv_keep_last": csv_keep_last,
    "csv_analysis": csv_analysis,
    "csv_bad_cell": csv_bad_cell,
    "stream_points": stream_points,
    "stream_metrics": stream_metrics,
    "stream_rejected": stream_rejected,
    "stream_mean": stream_mean,
    "stream_flushed": stream_flushed,
    "write_outcomes": write_outcomes,
}
