import datetime as dt
import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from meter_helpers import tuples, utc
from phasegrid.operators import reshape
from phasegrid.plans import live_active_power, workload
from phasegrid.schema import LIVE_FIELDS, POINT_KEY, POINT_SCHEMA
from phasegrid.sinks import compact_points, ensure_table, retained, write_lines, write_points
from phasegrid.sinks.points import batch_folders
from phasegrid.sources import latest_points, message_stream, point_log, read_json_lines, read_points
from phasegrid.streaming import (
    StreamMetrics,
    live,
    read_stream_metrics,
    read_windowed_mean,
    stop,
    stream_seconds,
    write_live,
    write_seconds,
)
from test_messages import message, meter


def live_point(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp, phase string, current double, voltage double").select(
        F.lit("em").alias("measurement"), F.lit("d").alias("device"), F.lit("live").alias("source"),
        "phase", "ts", "current", "voltage",
    )


NOON = utc("2024-01-01T12:00:00")


def test_later_batch_wins_field_by_field(spark, tmp_path):
    path = str(tmp_path / "store")
    outcome = write_points(live_point(spark, [(NOON, "a", 1.0, 10.0), (NOON, "b", 2.0, 20.0)]), path)
    assert (outcome.points, outcome.rows, outcome.error) == (2, None, None)
    write_points(live_point(spark, [(NOON, "a", 5.0, None)]), path, "second")
    expected = [("a", 5.0, 10.0), ("b", 2.0, 20.0)]
    assert tuples(read_points(spark, path), "phase", "current", "voltage") == expected
    # The same batch again replaces itself.
    write_points(live_point(spark, [(NOON, "a", 6.0, None)]), path, "second")
    assert point_log(spark, path).count() == 3
    assert tuples(read_points(spark, path), "phase", "current", "voltage")[0] == ("a", 6.0, 10.0)


def test_batch_written_again_leaves_no_old_day(spark, tmp_path):
    path = str(tmp_path / "store")
    days = [utc(f"2024-03-0{d}T01:00:00") for d in (1, 2, 3)]
    write_points(live_point(spark, [(t, "a", 1.0, 1.0) for t in days]), path, "mine")
    write_points(live_point(spark, [(days[0], "b", 1.0, 1.0)]), path, "other")
    write_points(live_point(spark, [(days[1], "a", 2.0, 2.0)]), path, "mine")
    assert tuples(read_points(spark, path), "ts", "phase") == [(days[0], "b"), (days[1], "a")]


def test_empty_write_reports_nothing(spark, tmp_path):
    outcome = write_points(live_point(spark, []), str(tmp_path / "store"))
    assert outcome.points == 0


def test_latest_does_not_depend_on_order(spark):
    rows = [(NOON, "a", float(i), None if i % 3 else float(i)) for i in range(200)]
    points = live_point(spark, rows).withColumn("written", F.col("current").cast("long")).repartition(5)
    assert tuples(latest_points(points), "current", "voltage") == [(199.0, 198.0)]


def test_bounds_and_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    path, zone = str(tmp_path / "store"), spark.conf.get("spark.sql.session.timeZone")
    times = [utc("2024-01-01T23:30:00"), utc("2024-01-02T02:00:00"), utc("2024-01-03T00:00:00")]
    points = live_point(spark, [(t, "a", float(i), 0.0) for i, t in enumerate(times)])
    found = {}
    for name in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            write_points(points, f"{path}-{name[:3]}")
            bounds = [("2024-01-01T23:00:00", "2024-01-02T03:00:00"), ("2024-01-02", None), (None, "2024-01-03"), (None, None)]
            found[name] = [tuples(read_points(spark, f"{path}-{name[:3]}", *b), "current") for b in bounds]
            assert sorted(f.name for f in (tmp_path / f"store-{name[:3]}" / "source=live").iterdir()) == [f"date=2024-01-0{d}" for d in (1, 2, 3)]
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    assert found["UTC"] == [[(0.0,), (1.0,)], [(1.0,), (2.0,)], [(0.0,), (1.0,)], [(0.0,), (1.0,), (2.0,)]]
    assert found["America/New_York"] == found["Asia/Tokyo"] == found["UTC"]


def test_time_range_prunes_dates_and_fields(spark, tmp_path):
    path = str(tmp_path / "store")
    days = [utc(f"2024-01-0{d}T12:00:00") for d in range(1, 6)]
    write_points(live_point(spark, [(t, "a", 1.0, 2.0) for t in days]), path)
    df = read_points(spark, path, "2024-01-02T12:00:00", "2024-01-04T12:00:00", ["current"])
    assert tuples(df, "ts") == [(days[1],), (days[2],)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "voltage" not in plan.split("ReadSchema: ")[1]


def test_compaction_and_retention(spark, tmp_path):
    path = str(tmp_path / "store")
    old, today = utc("2023-01-01"), NOON + dt.timedelta(days=1)
    write_points(live_point(spark, [(NOON, "a", 1.0, 1.0), (old, "a", 9.0, 9.0), (today, "a", 3.0, 3.0)]), path)
    last = write_points(live_point(spark, [(NOON, "a", 2.0, None), (today, "a", 4.0, None)]), path, written=5 * 10**15)
    assert len(tuples(retained(point_log(spark, path), NOON), "current")) == 4
    assert compact_points(spark, path, today.date(), now=NOON).points == 1
    log = point_log(spark, path).where("ts < TIMESTAMP '2024-01-02 00:00:00'")
    assert tuples(log, "current", "voltage", "written") == [(2.0, 1.0, 5 * 10**15)]
    # The open day is as it was, the old one is gone, and a second compaction finds nothing to do.
    assert point_log(spark, path).count() == 3
    assert compact_points(spark, path, today.date()) is None
    # A write after the compaction still wins.
    write_points(live_point(spark, [(NOON, "a", 7.0, None)]), path, written=5 * 10**15 + 1)
    assert tuples(read_points(spark, path, stop="2024-01-02"), "current", "voltage") == [(7.0, 1.0)]
    assert last.points == 2


def test_compaction_keeps_the_order_of_writes(spark, tmp_path):
    """A batch that began earlier than another series' merged batch, and is stored later, still wins over what it came after."""
    path = str(tmp_path / "store")
    write_points(live_point(spark, [(NOON, "a", 1.0, 1.0)]), path, written=10)
    write_points(live_point(spark, [(NOON, "b", 5.0, 5.0)]), path, written=30)
    compact_points(spark, path, dt.date(2030, 1, 1))
    write_points(live_point(spark, [(NOON, "a", 2.0, None)]), path, written=20)
    expected = [("a", 2.0, 1.0), ("b", 5.0, 5.0)]
    assert tuples(read_points(spark, path), "phase", "current", "voltage") == expected
    compact_points(spark, path, dt.date(2030, 1, 1))
    assert tuples(read_points(spark, path), "phase", "current", "voltage") == expected
    write_points(live_point(spark, [(NOON, "a", 0.5, 7.0)]), path, written=15)
    assert tuples(read_points(spark, path), "phase", "current", "voltage") == [("a", 2.0, 7.0), ("b", 5.0, 5.0)]


@pytest.mark.parametrize("seed", range(2))
def test_any_interleaving_of_writes_and_compactions(spark, tmp_path, seed):
    rng = random.Random(seed)
    path, wanted, written = str(tmp_path / "store"), {}, {}
    for i in range(7):
        rows = [
            (NOON + dt.timedelta(days=d), p, rng.choice([None, rng.random()]), rng.choice([None, rng.random()]))
            for d in range(2) for p in "ab" if rng.random() < 0.7
        ]
        # Two batches may begin in the same instant, and a later write may have begun earlier.
        name, began = f"b{i}", rng.randrange(4)
        write_points(live_point(spark, rows), path, name, written=began)
        written[name] = began, spark.range(1).select(F.xxhash64(F.lit(name))).first()[0]
        for ts, phase, *values in rows:
            for field, value in zip(("current", "voltage"), values, strict=True):
                held = wanted.get((ts, phase, field))
                if value is not None and (held is None or written[name] > held[0]):
                    wanted[ts, phase, field] = written[name], value
        if rng.random() < 0.5:
            compact_points(spark, path, rng.choice([dt.date(2024, 1, 2), dt.date(2030, 1, 1)]))
        found = {
            (r.ts, r.phase, f): r[f] for r in read_points(spark, path).collect() for f in ("current", "voltage") if r[f] is not None
        }
        assert found == {k: v for k, (_, v) in wanted.items()}


def test_a_merged_range_is_read_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in range(2):
        write_points(live_point(spark, [(NOON + dt.timedelta(days=d), "a", float(i), None) for d in range(3)]), path)
    compact_points(spark, path, dt.date(2024, 1, 3))
    merged = read_points(spark, path, stop="2024-01-02T12:00:01", fields=["current"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert tuples(merged, "ts", "current") == [(NOON, 1.0), (NOON + dt.timedelta(days=1), 1.0)]
    # An open day is merged, and only that one.
    both = read_points(spark, path, fields=["current"])
    assert "Exchange" in both._jdf.queryExecution().executedPlan().toString()
    assert [r[1] for r in tuples(both, "ts", "current")] == [1.0, 1.0, 1.0]
    assert read_points(spark, path, stop="2024-01-02T12:00:01", fields=["voltage"]).count() == 0


def test_table_follows_compaction_and_retention(spark, tmp_path):
    path = str(tmp_path / "store")
    old = utc("2020-01-01T00:00:00")
    for i in range(2):
        write_points(live_point(spark, [(NOON, "a", float(i), 1.0), (old, "a", 9.0, 9.0)]), path)
    ensure_table(spark, "points_in_step", path)
    assert spark.sql("SHOW PARTITIONS points_in_step").count() == 4
    compact_points(spark, path, dt.date(2024, 1, 2), now=NOON + dt.timedelta(days=3), table="points_in_step")
    shown = {r[0] for r in spark.sql("SHOW PARTITIONS points_in_step").collect()}
    assert shown == {f"source={s}/date={d}/batch={b}" for s, d, b, _ in batch_folders(spark, path)} and len(shown) == 1
    assert tuples(latest_points(spark.table("points_in_step")), "current", "voltage") == [(1.0, 1.0)]
    spark.sql("DROP TABLE points_in_step")


def test_table_shows_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    write_points(live_point(spark, [(NOON, "a", 1.0, 1.0)]), path)
    assert ensure_table(spark, "points_under_test", path)
    assert spark.table("points_under_test").count() == 1
    write_points(live_point(spark, [(NOON, "b", 1.0, 1.0)]), path)
    assert not ensure_table(spark, "points_under_test", path)
    assert spark.table("points_under_test").count() == 2
    assert set(spark.table("points_under_test").columns) == set(POINT_SCHEMA.names)
    spark.sql("DROP TABLE points_under_test")
    assert ensure_table(spark, "points_not_yet_written", str(tmp_path / "none"))
    spark.sql("DROP TABLE points_not_yet_written")


def test_streams_share_a_store(spark, tmp_path, devices):
    path, rejected = str(tmp_path / "store"), str(tmp_path / "rejected")
    for part, (start, count) in enumerate(((0, 6), (100, 8))):
        landing = tmp_path / f"in{part}"
        landing.mkdir()
        (landing / "1.txt").write_text("\n".join([*texts(start, count, 1.0), "{broken"]))
        query = write_live(
            message_stream(spark, str(landing)), devices, path, rejected, str(tmp_path / f"c{part}"), trigger={"availableNow": True}
        )
        assert query.awaitTermination(120)
    assert read_points(spark, path).where("phase = 'a'").count() == 14
    assert spark.read.parquet(rejected).count() == 2


def test_failed_batch_is_reported(spark, tmp_path, devices):
    landing, failed = tmp_path / "in", []
    landing.mkdir()
    (landing / "1.txt").write_text("\n".join(texts(0, 3)))

    def broken(events, outcome):
        raise RuntimeError(f"{outcome.rows} events seen")

    query = write_live(
        message_stream(spark, str(landing)), devices, str(tmp_path / "s"), str(tmp_path / "r"), str(tmp_path / "c"),
        trigger={"availableNow": True}, on_batch=broken, on_failure=failed.append,
    )
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(120)
    assert [("3 events seen" in o.error, o.points) for o in failed] == [(True, 0)]


@pytest.mark.parametrize("flush_rows", [1, 500])
def test_runs_of_streams_are_told(spark, tmp_path, devices, flush_rows):
    landing, path = tmp_path / "in", str(tmp_path / "metrics")
    landing.mkdir()
    for i in range(3):
        (landing / f"{i}.txt").write_text("\n".join(texts(i * 10, 4)))

    def broken(events, outcome):
        raise RuntimeError("disk full")

    metrics = StreamMetrics(spark, path, flush_rows)
    spark.streams.addListener(metrics)
    try:
        for name, on_batch in (("one", broken), ("two", None)):
            query = write_live(
                message_stream(spark, str(landing), max_files_per_trigger=1), devices, str(tmp_path / name), str(tmp_path / "r"),
                str(tmp_path / f"c{name}"), trigger={"availableNow": True}, on_batch=on_batch,
            )
            try:
                query.awaitTermination(120)
            except StreamingQueryException:
                pass
            assert metrics.finished(query)
    finally:
        spark.streams.removeListener(metrics)
    runs = {r["outcome"]: r for r in read_stream_metrics(spark, path).collect()}
    assert runs.keys() == {"failed", "ended"}
    assert (runs["failed"]["batches"], "disk full" in runs["failed"]["error"]) == (0, True)
    assert (runs["ended"]["batches"], runs["ended"]["input_rows"], runs["ended"]["error"]) == (3, 12, None)
    assert 0 < runs["ended"]["mean_ms"] <= runs["ended"]["longest_ms"]


def test_lines_round_trip(spark, tmp_path):
    lines = reshape.line_protocol(live_point(spark, [(NOON, "a", 1.0, 2.5)]))
    write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first().value == "em,device=d,phase=a,source=live current=1,voltage=2.5 1704110400"


@pytest.fixture
def devices(spark):
    return spark.createDataFrame([("meter-1", "kitchen"), ("meter-2", "cellar")], "src string, device string")


def texts(start, count, step=0.4):
    out = []
    for i in range(start, start + count):
        params = {"ts": 1700000000.25 + i * step, "em:0": meter() | {"a_act_power": float(i), "n_current": i / 4 if i % 2 else None}}
        out.append(json.dumps(message(src=f"meter-{1 + i % 2}", params=params)))
    return out


def current(df):
    return tuples(reshape.field_values(df, LIVE_FIELDS))


def test_stream_equals_batch_across_restarts(spark, tmp_path, devices):
    landing, path, rejected = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "rejected")
    landing.mkdir()
    seen = []

    def run():
        query = write_live(
            message_stream(spark, str(landing), 1), devices, path, rejected, str(tmp_path / "checkpoint"),
            trigger={"availableNow": True}, on_batch=lambda events, outcome: seen.append((events.count(), outcome.points)),
        )
        assert query.awaitTermination(120)

    (landing / "1.txt").write_text("\n".join([*texts(0, 30), "{broken", json.dumps(message(src="stranger"))]))
    run()
    (landing / "2.txt").write_text("\n".join(texts(20, 30)))
    (landing / "3.txt").write_text(json.dumps(message(method="NotifyEvent")) + "\n" + json.dumps(message(method="Other")))
    run()
    run()
    raw = read_json_lines(spark, str(landing))
    batch = live.batch_points(live.parse_events(raw, devices).where("route = 'status'"))
    assert current(read_points(spark, path)) == current(batch)
    assert sum(n for n, _ in seen) == 60
    reasons = tuples(spark.read.parquet(rejected), "error")
    assert reasons == [("not a message with a method",), ("unexpected method Other",), ("unknown source stranger",)]
    # Events of one second overwrite each other: the latest one counts.
    assert batch.count() < live.live_points(raw, devices).count()
    last = batch.where("phase = 'a' AND device = 'kitchen'").orderBy(F.desc("ts")).first()
    assert last.act_power == 48.0


def test_latest_events_are_hashed(spark, devices):
    raw = spark.createDataFrame([(t,) for t in texts(0, 10)], "value string")
    events = live.parse_events(raw, devices).where("route = 'status'")
    plan = live.batch_points(events)._jdf.queryExecution().executedPlan().toString()
    after = plan.split("Generate")[0]
    assert "HashAggregate" in after and "SortAggregate" not in after


def test_repeated_batch_leaves_no_copies(spark, tmp_path, devices):
    raw = spark.createDataFrame([(t,) for t in texts(0, 10)], "value string")
    points = live.batch_points(live.parse_events(raw, devices).where("route = 'status'"))
    for _ in range(2):
        write_points(points, str(tmp_path / "store"), "seven")
    log = point_log(spark, str(tmp_path / "store"))
    assert log.count() == points.count() == log.select(*POINT_KEY).distinct().count()


def test_stream_mean_equals_the_stored_one(spark, tmp_path, devices):
    landing, out = tmp_path / "in", str(tmp_path / "means")
    landing.mkdir()
    (landing / "1.txt").write_text("\n".join(texts(0, 150, 0.3)))
    (landing / "2.txt").write_text("\n".join(texts(150, 150, 2.0)))
    seconds = stream_seconds(message_stream(spark, str(landing), 1), devices, "act_power", "1 hour", phase="a")
    assert write_seconds(seconds, out, str(tmp_path / "c"), {"availableNow": True}).awaitTermination(120)
    events = live.parse_events(read_json_lines(spark, str(landing)), devices).where("route = 'status'")
    points = live.batch_points(events).where("phase = 'a'")
    batch = live_active_power(points, ["kitchen", "cellar"], "1m", "2023-01-01", "2024-01-01")
    got = tuples(read_windowed_mean(spark, out, "1 minute"), "device", "time", F.round("value", 6))
    assert got == tuples(batch, "device", "time", F.round("value", 6)) and len(got) >= 8
    assert points.count() < live.live_points(read_json_lines(spark, str(landing)), devices).where("phase = 'a'").count()


def test_stop(spark, tmp_path, devices):
    (tmp_path / "in").mkdir()
    query = write_live(
        message_stream(spark, str(tmp_path / "in")), devices, str(tmp_path / "s"), str(tmp_path / "r"), str(tmp_path / "c")
    )
    assert query.isActive and stop(query) and not query.isActive


@pytest.fixture
def shuffled(spark):
    """A plan without adaptive execution and broadcasts, as a stream's is with a large lookup."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "-1", "8"), strict=True):
        spark.conf.set(n, value)
    yield spark
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


def test_busy_source_and_messages_without_one_fill_no_single_task(shuffled):
    texts = [json.dumps(message({"total_current": float(i)}, src="meter-0")) for i in range(400)] + [f"broken {i}" for i in range(400)]
    raw = shuffled.createDataFrame([(t,) for t in texts], "value string")
    names = shuffled.createDataFrame([("meter-0", "d"), ("meter-1", "d")], "src string, device string")
    events = live.parse_events(raw, names)
    assert tuples(events.groupBy("route", "device", "source_rank").count()) == [("error", None, None, 400), ("status", "d", 1, 400)]
    sizes = events.groupBy("route", F.spark_partition_id().alias("task")).count().groupBy("route").agg(F.max("count")).collect()
    assert all(most < 200 for _, most in sizes)


def test_stream_keeps_messages_where_they_were_read(spark, tmp_path):
    folder, told = tmp_path / "in", []
    texts = [json.dumps(message({"total_current": float(i)}, src="meter-0")) for i in range(200)]
    spark.createDataFrame([(t,) for t in texts], "value string").repartition(4).write.text(str(folder))
    names = spark.createDataFrame([("meter-0", "d")], "src string, device string")

    def seen(accepted, outcome):
        told.extend(r["count"] for r in accepted.groupBy(F.spark_partition_id()).count().collect())

    path = str(tmp_path / "store")
    write_live(
        message_stream(spark, str(folder)), names, path, f"{path}-rejected", f"{path}-checkpoint", {"availableNow": True}, on_batch=seen
    ).awaitTermination()
    assert sum(told) == 200 and max(told) < 200


def test_merging_tasks_hold_a_bounded_number_of_points(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    times = [NOON + dt.timedelta(seconds=i) for i in range(500)]
    for k in (1.0, 2.0):
        write_points(live_point(spark, [(t, "a", k, None if k > 1 else k) for t in times]), path, f"b{k}")
    monkeypatch.setattr("phasegrid.sources.points.POINTS_PER_TASK", 100)
    points = read_points(spark, path, fields=["current", "voltage"])
    assert tuples(points, "ts", "current", "voltage") == [(t, 2.0, 1.0) for t in times]
    assert points.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 100
    assert read_points(spark, path, stop="2024-01-01T12:00:00").count() == 0
    compact_points(spark, path, dt.date(2100, 1, 1))
    assert point_log(spark, path).count() == 500
    assert tuples(read_points(spark, path), "ts", "current", "voltage") == [(t, 2.0, 1.0) for t in times]


def test_messages_are_dealt_out_before_they_are_texts(spark, tmp_path):
    rows = [(i, utc(f"2024-01-0{1 + i % 9}T00:00:00"), i, "view", float(i), "{}") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(
        1
    ).write.parquet(str(tmp_path / "events.parquet"))
    halves = [workload._half_of_messages(spark, str(tmp_path), half) for half in (0, 1)]
    assert all(h.rdd.getNumPartitions() == 3 and h.groupBy(F.spark_partition_id()).count().count() == 3 for h in halves)
    assert tuples(halves[0].union(halves[1])) == tuples(workload.status_messages(spark, str(tmp_path)))
