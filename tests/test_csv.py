import pytest
from pyspark.sql import functions as F

from meter_helpers import tuples, utc
from phasegrid import DeviceSource, MeterData
from phasegrid.operators.dedup import dedup
from phasegrid.plans import import_csv
from phasegrid.schema import MEASURES, WIDE_COLUMNS
from phasegrid.sources import csv
from phasegrid.sources.csv import load_csv_files, load_readings, read_csv_dir
from phasegrid.sources.points import read_points


def test_empty_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="At least one device"):
        MeterData.load(spark, [])
    with pytest.raises(ValueError, match="At least one file"):
        load_csv_files(spark, [], "d")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.csv").write_text("timestamp\n1\n")
    (tmp_path / "note.txt").write_text("x")
    with pytest.raises(ValueError, match="No CSV files for 'd'"):
        read_csv_dir(spark, DeviceSource(str(tmp_path), "d"))


def test_load_devices(spark, tmp_path, write_csv):
    # Folder names with characters that patterns and URIs treat specially.
    one, two = tmp_path / "a[1] {x}+%", tmp_path / "b"
    f1 = write_csv(one / "x_1.csv", [0, 60, 120])
    f2 = write_csv(one / "x_2.csv", [120, 180])
    f3 = write_csv(two / "y.csv", [120])
    write_csv(two / "sub" / "z.csv", [999])
    data = MeterData.load(spark, [DeviceSource(str(one), "dev1"), DeviceSource(f"file://{two}/", "dev2")])
    assert data.readings.columns == [*WIDE_COLUMNS, "device", "file"]
    assert dict(data.readings.dtypes)["timestamp"] == "timestamp"
    got = tuples(data.readings, "device", F.unix_seconds("timestamp"), "file")
    assert got == [("dev1", 0, f1), ("dev1", 60, f1), ("dev1", 120, f1), ("dev1", 180, f2), ("dev2", 120, f3)]
    assert tuples(data.files, "device", "file", "n_rows") == [("dev1", f1, 3), ("dev1", f2, 2), ("dev2", f3, 1)]
    assert tuples(data.statistics, "device", "total_rows", "n_gaps") == [("dev1", 4, 0), ("dev2", 1, 0)]
    assert data.gaps.count() == 0 and data.duplicate_files.count() == 0
    assert len(data.statistics_lines("UTC").collect()) == 2
    assert data.phase_data.count() == 15 and data.phase_data_column("avg_current").count() == 15
    assert data.daily_total_energy().count() == 6
    assert [r.day_of_week for r in data.total_energy_by_day_of_week().collect()] == ["Thursday"] * 6
    assert data.total_energy("1mo", None).count() == 1


def test_one_folder_for_two_devices(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x.csv", [0])
    rows = load_readings(spark, [DeviceSource(str(tmp_path), d) for d in ("p", "q")])
    assert tuples(rows, "device") == [("p",), ("q",)]


def test_position_orders_rows_of_split_files(spark, tmp_path, write_csv):
    path = write_csv(tmp_path / "x.csv", [(i % 50) * 60 for i in range(400)], change={"a_avg_current": "7"})
    text = (tmp_path / "x.csv").read_text().splitlines()
    column = WIDE_COLUMNS.index("b_avg_current")
    marked = [text[0]]
    for i, line in enumerate(text[1:]):
        cells = line.split(",")
        cells[column] = str(i)
        marked.append(",".join(cells))
    (tmp_path / "x.csv").write_text("\n".join(marked) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = load_csv_files(spark, [path], "d")
        assert rows.rdd.getNumPartitions() > 4
        first, last = (tuples(dedup(rows, k), F.col("b_avg_current").cast("int")) for k in ("first", "last"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert first == [(i,) for i in range(50)] and last == [(i,) for i in range(350, 400)]


def test_reordered_header(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x_1.csv", [0])
    write_csv(tmp_path / "x_2.csv", [60], columns=WIDE_COLUMNS[::-1])
    source = [DeviceSource(str(tmp_path), "d")]
    for strict in (False, True):
        rows = load_readings(spark, source, strict=strict).orderBy("timestamp").collect()
        assert [r[1:52] for r in rows] == [tuple(float(t + i) for i in range(1, 52)) for t in (0, 60)]
    with pytest.raises(Exception, match="(?i)header"):
        load_readings(spark, source, any_order=False).collect()


@pytest.mark.parametrize("columns", [(*WIDE_COLUMNS, "more"), WIDE_COLUMNS[:-1]])
def test_wrong_header(spark, tmp_path, write_csv, columns):
    path = write_csv(tmp_path / "x.csv", [0], columns=columns)
    with pytest.raises(ValueError, match="Header of") as info:
        load_readings(spark, [DeviceSource(str(tmp_path), "d")])
    assert path in str(info.value)


def test_empty_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    with pytest.raises(ValueError, match="without a header.*x.csv"):
        load_readings(spark, [DeviceSource(str(tmp_path), "d")])


def test_header_only_file(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x.csv", [0])
    bare = write_csv(tmp_path / "y.csv", [])
    source = [DeviceSource(str(tmp_path), "d")]
    with pytest.raises(ValueError, match="No rows in CSV file") as info:
        MeterData.load(spark, source)
    assert bare in str(info.value)
    assert load_readings(spark, source).count() == 1


@pytest.mark.parametrize("cell", ["", "soon"])
def test_unreadable_time_fails_an_analysis(spark, tmp_path, write_csv, cell):
    path = write_csv(tmp_path / "x.csv", [0, 60])
    text = (tmp_path / "x.csv").read_text().replace("\n60,", f"\n{cell},")
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception, match="No time in a row") as info:
        MeterData.load(spark, [DeviceSource(str(tmp_path), "d")]).files.collect()
    assert path in str(info.value)


def test_time_range_reaches_the_scan(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x.csv", range(0, 600, 60))
    source = [DeviceSource(str(tmp_path), "d")]
    rows = MeterData.load(spark, source, start="1970-01-01T00:01:30", end="1970-01-01T00:05:00+00:00").rows
    assert tuples(rows, F.unix_seconds("timestamp")) == [(120,), (180,), (240,), (300,)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(timestamp,90)" in pushed and "LessThanOrEqual(timestamp,300)" in pushed


def test_headers_of_a_store_only_spark_opens(spark, tmp_path, write_csv, monkeypatch):
    write_csv(tmp_path / "x_1.csv", [0])
    write_csv(tmp_path / "x_2.csv", [60], columns=WIDE_COLUMNS[::-1])
    monkeypatch.setattr(csv, "_opens", lambda path: False)
    rows = load_readings(spark, [DeviceSource(str(tmp_path), "d")], strict=True).orderBy("timestamp").collect()
    assert [r[1:52] for r in rows] == [tuple(float(t + i) for i in range(1, 52)) for t in (0, 60)]
    (tmp_path / "x_3.csv").write_text("")
    with pytest.raises(ValueError, match="without a header.*x_3.csv"):
        load_readings(spark, [DeviceSource(str(tmp_path), "d")])


def test_import_goes_on_past_a_device_without_files(spark, tmp_path, write_csv):
    write_csv(tmp_path / "one" / "x.csv", [0])
    (tmp_path / "two").mkdir()
    sources = [DeviceSource(str(tmp_path / d), d) for d in ("one", "two", "three")]
    assert import_csv(spark, sources, str(tmp_path / "store")).rows == 1
    assert import_csv(spark, sources[1:], str(tmp_path / "store")).points == 0
    assert tuples(read_points(spark, str(tmp_path / "store")).select("device").distinct()) == [("one",)]


@pytest.mark.parametrize("cell", ["", "abc"])
def test_bad_values(spark, tmp_path, write_csv, cell):
    write_csv(tmp_path / "x.csv", [0], change={"c_max_voltage": cell})
    source = [DeviceSource(str(tmp_path), "d")]
    row = load_readings(spark, source).first()
    assert row.c_max_voltage is None and row.a_max_voltage is not None
    # Every value counts, also of columns the query does not use.
    with pytest.raises(Exception, match="Value missing: c_max_voltage|MALFORMED|FAILED_READ_FILE"):
        load_readings(spark, source, strict=True).select("device").collect()


@pytest.mark.parametrize("columns", [WIDE_COLUMNS, WIDE_COLUMNS[::-1]])
@pytest.mark.parametrize("change", ["text", "long", "short"])
def test_a_bad_cell_fails_an_analysis_of_other_columns(spark, tmp_path, write_csv, columns, change):
    write_csv(tmp_path / "one" / "x.csv", [0, 60])
    path = write_csv(tmp_path / "two" / "y.csv", [0], columns=columns, change={"c_max_voltage": "abc"} if change == "text" else None)
    if change != "text":
        head, row = (tmp_path / "two" / "y.csv").read_text().splitlines()
        (tmp_path / "two" / "y.csv").write_text(f"{head}\n{row + ',1' if change == 'long' else row.rsplit(',', 1)[0]}\n")
    sources = [DeviceSource(str(tmp_path / d), d) for d in ("one", "two")]
    with pytest.raises(Exception, match="Cannot read|No time") as info:
        MeterData.load(spark, sources).total_energy("1d").collect()
    text = str(info.value)
    assert f"{path}, device two" in text and ("c_max_voltage" in text) == (change == "text")
    data = MeterData.load(spark, sources, set_aside=True)
    assert tuples(data.readings, "device") == [("one",), ("one",)]
    rejected = data.rejected.collect()
    assert [(r.device, r.file) for r in rejected] == [("two", path)]
    assert change != "text" or rejected[0].columns == ["c_max_voltage"]


def test_empty_cells_are_no_faults(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x.csv", [0], change={"a_total_act_energy": ""})
    data = MeterData.load(spark, [DeviceSource(str(tmp_path), "d")])
    assert data.readings.first().a_total_act_energy is None and data.readings.first().b_total_act_energy is not None
    assert tuples(data.total_energy("1d"), "phase", "total_act_energy_kwh")[0] == ("a", 0.0)


def test_a_row_without_a_time_fails_within_bounds_too(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x.csv", [0, 60, 120])
    (tmp_path / "x.csv").write_text((tmp_path / "x.csv").read_text().replace("\n60,", "\nsoon,"))
    with pytest.raises(Exception, match="No time in a row"):
        MeterData.load(spark, [DeviceSource(str(tmp_path), "d")], start="1970-01-01T00:01:30").readings.collect()


def test_files_are_listed_by_spark(spark, tmp_path, write_csv):
    write_csv(tmp_path / "x_1.csv", [0])
    write_csv(tmp_path / "x_2.csv", [], columns=WIDE_COLUMNS[::-1])
    (tmp_path / "x_3.csv").write_text("\n \n" * 5000)
    index = csv.file_index(spark, [str(tmp_path)])
    assert tuples(index, "file", "has_rows") == [(str(tmp_path / f"x_{i}.csv"), i == 1) for i in (1, 2, 3)]
    assert {r.folder for r in index.collect()} == {str(tmp_path)}
    plan = csv.file_index(spark, [str(tmp_path)], headers=False)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_import_keeps_last(spark, tmp_path, write_csv):
    source = tmp_path / "in"
    write_csv(source / "x_1.csv", [0, 60], change={"a_avg_current": "1.5"})
    write_csv(source / "x_2.csv", [60, 120], change={"a_avg_current": "2.5"})
    outcome = import_csv(spark, [DeviceSource(str(source), "dev")], str(tmp_path / "store"))
    assert (outcome.rows, outcome.points) == (3, 12)
    points = read_points(spark, str(tmp_path / "store"), "1970-01-01", "1970-01-02", ["avg_current"])
    assert tuples(points.where("phase = 'a'"), F.unix_seconds("ts"), "avg_current") == [(0, 1.5), (60, 2.5), (120, 2.5)]
    assert len(MEASURES) == 16 and tuples(points, "phase")[-1] == ("neutral",)
    assert points.agg(F.max("ts")).first()[0] == utc("1970-01-01T00:02:00")
