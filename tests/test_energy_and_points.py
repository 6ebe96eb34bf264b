import datetime as dt

import pytest
from pyspark.sql import functions as F

from meter_helpers import tuples, utc
from phasegrid.operators import energy, filters, joins, reshape
from phasegrid.operators.dedup import dedup, import_counts
from phasegrid.schema import LIVE_FIELDS, MEASURES, NEUTRAL_MEASURES, WIDE_COLUMNS

DAY = 86_400
MONDAY = 4 * DAY  # 1970-01-05
AT = dt.datetime(2023, 8, 2, 6, 15, 31)


@pytest.fixture
def sample(readings):
    rows = [
        ("d", "f", 0, MONDAY - 1, 1.0, 2.0, None),
        ("d", "f", 1, MONDAY, 3.0, 4.0, None),
        ("d", "f", 2, MONDAY + 7 * DAY, 5.0, None, None),
        ("e", "g", 3, MONDAY + 8 * DAY, 7.0, 8.0, 9.0),
    ]
    return readings(rows)


def test_weekly_energy(sample):
    got = tuples(energy.total_energy(sample, "1w").where("device = 'd'"), "phase", F.col("date").cast("string"), "total_act_energy_kwh")
    assert got == [
        ("a", "1969-12-29", 1.0 * 0.001), ("a", "1970-01-05", 3.0 * 0.001), ("a", "1970-01-12", 5.0 * 0.001),
        ("b", "1969-12-29", 2.0 * 0.001), ("b", "1970-01-05", 4.0 * 0.001), ("b", "1970-01-12", 0.0),
        ("c", "1969-12-29", 0.0), ("c", "1970-01-05", 0.0), ("c", "1970-01-12", 0.0),
    ]
    assert energy.total_energy(sample, "1w").columns == ["device", "phase", "date", "total_act_energy_kwh"]


def test_group_choices(sample):
    total = energy.total_energy(sample, "1w", None)
    assert total.columns == ["date", "total_act_energy_kwh"]
    assert tuples(total, F.round("total_act_energy_kwh", 9)) == [(0.003,), (0.007,), (0.029,)]
    phases = energy.total_energy(sample, "1y", ("phase",))
    assert tuples(phases, "phase", F.round("total_act_energy_kwh", 9)) == [("a", 0.016), ("b", 0.014), ("c", 0.009)]
    files = energy.total_energy(sample, "1mo", ("file", "device"))
    assert files.columns[:2] == ["file", "device"]
    with pytest.raises(ValueError, match="group"):
        energy.total_energy(sample, "1w", ("colour",))


def test_start_by(sample):
    def starts(every, start_by):
        df = energy.total_energy(sample.where("device = 'd'"), every, ("device",), start_by, keep_window_start=True)
        return [r[0] for r in tuples(df, "window_start")]

    assert starts("1w", "thursday") == [utc("1970-01-01"), utc("1970-01-08")]
    assert starts("1d", "datapoint")[0] == utc("1970-01-04T23:59:59")
    assert starts("2w", "tuesday") == [utc("1969-12-30")]
    with pytest.raises(ValueError, match="start_by"):
        energy.total_energy(sample, "1w", start_by="noon")


def test_weekday_profile_counts_days_with_data(readings):
    rows = [("d", "f", i, MONDAY + k * DAY + 60 * i, float(v), 0.0, 0.0) for i, (k, v) in enumerate([(0, 1), (0, 2), (7, 5), (9, 4)])]
    got = tuples(energy.weekday_energy(readings(rows)).where("phase = 'a'"), "day_of_week_num", "day_of_week", F.round("total_act_energy_kwh", 9))
    assert got == [(1, "Monday", 0.004), (3, "Wednesday", 0.004)]


def test_energy_prunes_columns(spark, tmp_path):
    wide = spark.range(3).select(
        F.timestamp_seconds("id").alias("timestamp"), F.lit("d").alias("device"), F.lit("f").alias("file"),
        F.col("id").alias("pos"), *[F.lit(1.0).alias(c) for c in WIDE_COLUMNS[1:]],
    )
    wide.write.parquet(str(tmp_path / "w"))
    df = energy.daily_total_energy(dedup(spark.read.parquet(str(tmp_path / "w"))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "a_total_act_energy" in schema and "voltage" not in schema


def test_windowed_mean_labels(spark):
    rows = [(utc("2024-01-01T00:30:00"), 1.0), (utc("2024-01-01T00:59:59"), 3.0), (utc("2024-01-01T01:30:00"), 8.0),
            (utc("2024-01-01T02:00:00"), 100.0), (utc("2024-01-01T00:10:00"), 100.0)]
    df = spark.createDataFrame(rows, "ts timestamp, value double").selectExpr(
        "'em' AS measurement", "'d' AS device", "'csv' AS source", "'a' AS phase", "ts", "'f' AS field", "value"
    )
    got = tuples(energy.windowed_mean(df, "1h", "2024-01-01 00:15:00", "2024-01-01 01:45:00"), "time", "value")
    assert got == [(utc("2024-01-01T01:00:00"), 2.0), (utc("2024-01-01T01:45:00"), 8.0)]
    got = tuples(energy.windowed_mean(df, "1mo", "2024-01-01", "2024-03-01"), "time")
    assert got == [(utc("2024-02-01"),)]


def wide_row(spark, **values):
    cells = {c: None for c in WIDE_COLUMNS[1:]} | values
    return spark.range(1).select(
        F.lit(f"{AT} UTC").cast("timestamp").alias("timestamp"), F.lit("barn").alias("device"),
        F.lit("file").alias("file"), *[F.lit(v).cast("double").alias(c) for c, v in cells.items()],
    )


def test_csv_points_as_lines(spark):
    values = {f"b_{m}": (i + 1) * 0.25 for i, m in enumerate(MEASURES)} | {f"n_{m}": 40.0 + i for i, m in enumerate(NEUTRAL_MEASURES)}
    points = reshape.reading_points(wide_row(spark, **values))
    assert points.count() == 4
    seconds = int(AT.replace(tzinfo=dt.timezone.utc).timestamp())

    def fields(prefix, measures):
        return ",".join(f"{m}={values[f'{prefix}_{m}']:.10g}" for m in sorted(measures))

    assert tuples(reshape.line_protocol(points)) == [
        (f"em,device=barn,phase=b,source=csv {fields('b', MEASURES)} {seconds}",),
        (f"em,device=barn,phase=neutral,source=csv {fields('n', NEUTRAL_MEASURES)} {seconds}",),
    ]
    assert reshape.field_values(points).count() == len(MEASURES) + len(NEUTRAL_MEASURES)
    assert reshape.field_values(points, ["max_voltage"]).count() == 1


def test_line_escapes(spark):
    df = spark.sql("SELECT 'e m' AS measurement, 'a b,c=d' AS device, 'csv' AS source, '' AS phase, timestamp_seconds(1) AS ts, 1D AS current")
    assert reshape.line_protocol(df).first().line == "e\\ m,device=a\\ b\\,c\\=d,source=csv current=1 1"


def test_event_points(spark):
    per_phase = {f: 8.5 - i for i, f in enumerate(LIVE_FIELDS)}
    phase = ", ".join(f"{v}D AS {f}" for f, v in per_phase.items())
    one = f"struct('a' AS phase_name, {phase}, array() AS errors)"
    events = spark.sql(f"""SELECT 'barn' AS device, timestamp '{AT} UTC' + INTERVAL 0.7 SECOND AS timestamp, struct(
        array({one}, {one}, {one}) AS phases, n AS n_current, 30.5D AS total_current, 10.25D AS total_act_power,
        20.75D AS total_aprt_power) AS status FROM VALUES (0.75D), (NULL) AS t(n)""")
    lines = [line for (line,) in tuples(reshape.line_protocol(reshape.event_points(events)).distinct())]
    seconds = int(AT.replace(tzinfo=dt.timezone.utc).timestamp())
    fields = ",".join(f"{f}={v:g}" for f, v in sorted(per_phase.items()))
    assert lines[0] == f"em,device=barn,phase=a,source=live {fields} {seconds}"
    assert lines[-2] == f"em,device=barn,phase=neutral,source=live current=0.75 {seconds}"
    assert lines[-1] == f"em,device=barn,phase=total,source=live act_power=10.25,aprt_power=20.75,current=30.5 {seconds}"
    assert reshape.event_points(events).where("phase = 'neutral'").count() == 1


@pytest.mark.parametrize("measure", MEASURES)
def test_phase_column(spark, measure):
    df = reshape.phase_column(wide_row(spark, **{f"a_{measure}": 1.0, f"c_{measure}": 3.0}), measure)
    assert df.columns == ["timestamp", "device", "file", "phase", measure]
    assert sorted(tuple(r) for r in df.select("phase", F.coalesce(measure, F.lit(-1.0))).collect()) == [("a", 1.0), ("b", -1.0), ("c", 3.0)]


def test_phase_table_and_nesting(spark):
    df = reshape.phase_table(wide_row(spark, b_max_voltage=7.0))
    assert df.columns == ["timestamp", "device", "file", "phase", *MEASURES] and df.count() == 3
    nested = reshape.nest_readings(wide_row(spark, a_avg_current=3.25, n_avg_current=1.5)).first()
    assert [p.phase_name for p in nested.phases] == ["a", "b", "c"]
    assert nested.phases[0].avg_current == 3.25 and nested.n_avg_current == 1.5
    assert len(nested) == 3 + len(NEUTRAL_MEASURES)


def test_measure_that_no_phase_has(spark):
    with pytest.raises(ValueError, match="'brightness' is no phase measure"):
        reshape.phase_column(wide_row(spark), "brightness")


def test_join_validation(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string")
    right = spark.createDataFrame([(1, "p"), (1, "q")], "k int, r string")
    assert joins.join_validated(left, right, ["k"]).count() == 3
    assert joins.join_validated(left, right, ["k"], validate="1:m").count() == 3
    assert tuples(joins.join_validated(right, left, ["k"], validate="m:1")) == [(1, "p", "x"), (1, "q", "x")]
    for kind in ("1:1", "m:1"):
        with pytest.raises(Exception, match="Key is not unique"):
            joins.join_validated(left, right, ["k"], validate=kind).collect()
    with pytest.raises(ValueError):
        joins.join_validated(left, right, ["k"], validate="2:1")


def test_size_of_a_lookup_is_left_to_spark(spark):
    messages = spark.range(100).selectExpr("CAST(id AS STRING) AS src")
    few = spark.createDataFrame([(str(i), f"d{i}") for i in range(10)], "src string, device string")
    joined = joins.attach_device_name(messages, joins.device_lookup(few))
    assert joined.where("device IS NOT NULL").count() == 10
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.attach_device_name(messages, joins.device_lookup(few))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_unique_check_hashes_numbers(spark):
    numbers = spark.range(10).selectExpr("id AS k", "id * 2D AS v", "timestamp_seconds(id) AS t")
    plan = joins.require_unique(numbers, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_two_records_of_a_device_fail(spark):
    info = spark.createDataFrame([("d", 1), ("d", 2)], "device string, gen int")
    with pytest.raises(Exception, match="Key is not unique"):
        joins.attach_device_info(spark.createDataFrame([("d",)], "device string"), info).collect()


def test_counts_need_no_expand(spark, sample):
    counts = import_counts(sample.union(sample))
    assert tuples(counts, "device", "total_rows", "unique_rows", "n_files") == [("d", 6, 3, 1), ("e", 2, 1, 1)]
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("first, hours", [("2024-10-27T00:00:00", 3), ("2024-03-31T00:00:00", 3)])
def test_clock_windows_over_a_clock_change(readings, first, hours):
    start = int(utc(first).replace(tzinfo=dt.timezone.utc).timestamp())
    rows = [("d", "f", i, start + 900 * i, 1.0, 0.0, 0.0) for i in range(4 * hours)]
    energies = energy.total_energy(readings(rows).where("device = 'd'"), "1h", ("device",), tz="Europe/Berlin", keep_window_start=True)
    assert tuples(energies, F.unix_seconds("window_start"), F.round("total_act_energy_kwh", 6)) == [(start + 3600 * h, 0.004) for h in range(hours)]


def test_filters(spark):
    df = spark.range(0, 600, 60).select(F.timestamp_seconds("id").alias("timestamp"), F.col("id").cast("string").alias("device"))
    both = filters.between(df, "1970-01-01T00:01:00", "1970-01-01T00:03:00+00:00")
    assert both.count() == 3
    assert filters.in_range(df, "1970-01-01T00:01:00", "1970-01-01T00:03:00").count() == 2
    assert filters.between(df).count() == 10
    assert filters.not_older_than(df, "1h", utc("1970-01-01T01:05:00")).count() == 5
    assert filters.not_older_than(df, "all", utc("1970-01-01T01:05:00")).count() == 10
    assert filters.with_tags(df, device=["0", "60"]).count() == 2
    assert filters.with_tags(df, device="60").count() == 1
