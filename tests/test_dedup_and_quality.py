import random

import pytest
from pyspark.sql import functions as F

from meter_helpers import tuples, utc
from phasegrid import MeterData
from phasegrid.operators import dedup as dd
from phasegrid.operators import quality


def row(device, file, pos, s, v=0.0):
    return (device, file, pos, s, float(v), 0.0, 0.0)


#: Three files: p holds minutes 0, 7, 9; q holds 9, 11; r holds 7, 11, 20, 20.
OVERLAP = [
    *(row("d", "p.csv", i, 60 * m, 10 + m) for i, m in enumerate([0, 7, 9])),
    *(row("d", "q.csv", i, 60 * m, 30 + m) for i, m in enumerate([9, 11])),
    *(row("d", "r.csv", i, 60 * m, 50 + i) for i, m in enumerate([7, 11, 20, 20])),
]


def test_keep_first_and_last(readings):
    first = dd.dedup(readings(OVERLAP), "first").orderBy("timestamp").collect()
    assert [r.file[0] for r in first] == ["p", "p", "p", "q", "r"]
    assert [r.a_total_act_energy for r in first] == [10, 17, 19, 41, 52]
    last = dd.dedup(readings(OVERLAP), "last").orderBy("timestamp").collect()
    assert [r.file[0] for r in last] == ["p", "r", "q", "r", "r"]
    assert [r.a_total_act_energy for r in last] == [10, 50, 39, 51, 53]
    with pytest.raises(ValueError):
        dd.dedup(readings(OVERLAP), "any")


def test_devices_are_not_merged(readings):
    two = readings([("e" if r[1] == "r.csv" else "d", *r[1:]) for r in OVERLAP])
    assert dd.dedup(two).count() == 7


@pytest.mark.parametrize("seed", range(3))
def test_dedup_ignores_input_order(spark, readings, seed):
    rng = random.Random(seed)
    rows = [row(f"d{rng.randrange(2)}", f"f{rng.randrange(4)}", i, rng.randrange(40) * 60, i) for i in range(400)]
    # One key holds a third of all rows.
    rows += [row("d0", f"f{rng.randrange(4)}", 1000 + i, 0, i) for i in range(200)]
    expected = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        expected.setdefault((r[0], r[3]), (r[1], r[2]))
    last = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        last[r[0], r[3]] = (r[1], r[2])
    rng.shuffle(rows)
    df = readings(rows).repartition(7)
    for keep, wanted in (("first", expected), ("last", last)):
        got = {(r.device, r.s): (r.file, r.pos) for r in dd.dedup(df, keep).withColumn("s", F.unix_seconds("timestamp")).collect()}
        assert got == wanted


def test_import_counts(readings):
    assert tuples(dd.import_counts(readings(OVERLAP))) == [("d", 9, 5, 3)]


def test_dedup_limits_before_the_shuffle(readings):
    plan = dd.dedup(readings(OVERLAP))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_gaps_are_strictly_longer(readings):
    df = readings([row("d", "f", i, s) for i, s in enumerate([300, 0, 121, 60, 60])])
    got = tuples(quality.gaps(df), "device", "start", "end", "duration_s")
    epoch = lambda s: utc("1970-01-01T00:00:00") + (utc("1970-01-01T00:01:00") - utc("1970-01-01T00:00:00")) * s / 60
    assert got == [("d", epoch(60), epoch(121), 61.0), ("d", epoch(121), epoch(300), 179.0)]
    assert quality.gaps(df).dtypes[3] == ("duration", "interval day to second")


@pytest.mark.parametrize("seed, threshold", [(0, 60), (1, 60), (2, 7), (3, 0.5), (4, 86_400)])
def test_gaps_and_stats_match_a_loop(spark, seed, threshold):
    rng = random.Random(seed)
    micros = {d: [int(rng.expovariate(1) * threshold * 1e6 * rng.choice([0.1, 1, 40_000])) for _ in range(300)] for d in "xyz"}
    times = {d: [sum(steps[: i + 1]) - 10**9 for i in range(len(steps))] for d, steps in micros.items()}
    rows = [(d, t) for d, ts in times.items() for t in ts + ts[::3]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "device string, us long").select(
        "device", F.timestamp_micros("us").alias("timestamp")
    )
    expected = []
    for d, ts in times.items():
        ts = sorted(set(ts))
        expected += [(d, a, b) for a, b in zip(ts, ts[1:]) if b - a > threshold * 1e6]
    got = quality.gaps(df, threshold).select("device", F.unix_micros("start"), F.unix_micros("end"))
    assert tuples(got) == sorted(expected)
    stats = tuples(
        quality.device_stats(df, threshold),
        "device", "total_rows", F.unix_micros("first_ts"), F.unix_micros("last_ts"), "n_gaps",
    )
    assert stats == [
        (d, len(set(ts)), min(ts), max(ts), sum(e[0] == d for e in expected)) for d, ts in sorted(times.items())
    ]


def test_gap_lists(readings):
    df = readings([row("d", "f", i, s) for i, s in enumerate([0, 500, 560, 9000])] + [row("e", "f", 9, 0)])
    lists = quality.with_gap_list(quality.device_stats(df), quality.gaps(df)).orderBy("device").collect()
    assert [(r.device, r.n_gaps, [g.duration_s for g in r.gaps]) for r in lists] == [("d", 2, [500.0, 8440.0]), ("e", 0, [])]


def test_no_files_to_compare(readings):
    with pytest.raises(ValueError, match="no files"):
        MeterData(readings(OVERLAP).limit(0)).duplicate_files


def test_gap_threshold_must_be_positive(readings):
    with pytest.raises(ValueError):
        quality.gaps(readings(OVERLAP), 0)


def test_lines(readings):
    df = readings([row("d", "f.csv", 0, 0), row("d", "f.csv", 1, 60), row("d", "f.csv", 2, 90_000)])
    line = quality.stats_lines(quality.device_stats(df), "Europe/Berlin").first().line
    assert line == "Device 'd' with 3 rows from 1970-01-01 01:00 to 1970-01-02 02:00 (1 day, 1:00:00) with 1 gaps"
    line = quality.file_lines(quality.file_stats(df)).first().line
    assert line == "Device 'd' / f.csv: 1970-01-01 00:00:00+00:00 .. 1970-01-02 01:00:00+00:00 (3 rows)"


#: Files as name, first hour, last hour, rows; then the redundant ones.
CASES = {
    "alone": ([("k", 5, 9, 40)], []),
    "cut at both ends": ([("k", 2, 20, 90), ("m", 6, 11, 30), ("n", 19, 20, 2)], ["m", "n"]),
    "starts within, ends later": ([("k", 2, 12, 50), ("m", 11, 15, 9)], []),
    "one after the other": ([("k", 0, 3, 8), ("m", 4, 8, 8), ("n", 9, 9, 1)], []),
    "same start, shorter": ([("k", 7, 17, 60), ("m", 7, 13, 20)], ["m"]),
    "same end, later start": ([("k", 1, 23, 99), ("m", 22, 23, 3)], ["m"]),
    "copies": ([("m", 3, 6, 12), ("k", 3, 6, 12), ("n", 3, 6, 12)], ["m", "n"]),
    "more rows lead": ([("k", 3, 6, 4), ("m", 3, 6, 12)], ["k"]),
    "same start, fewer rows but longer": ([("k", 3, 8, 5), ("m", 3, 6, 12)], []),
    "inside a file that does not lead": ([("k", 0, 4, 9), ("m", 6, 18, 9), ("n", 8, 10, 2)], []),
    "a single instant": ([("k", 4, 4, 1), ("m", 4, 4, 1)], ["m"]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("reverse", [False, True])
def test_duplicate_files(spark, name, reverse):
    files, expected = CASES[name]
    rows = [("dev", f, utc(f"2022-02-11T{a:02d}:00:00"), utc(f"2022-02-11T{b:02d}:00:00"), n) for f, a, b, n in files]
    rows += [("other", f"o{f}", a, b, n) for _, f, a, b, n in rows]
    df = spark.createDataFrame(
        rows[::-1] if reverse else rows,
        "device string, file string, first_ts timestamp, last_ts timestamp, n_rows long",
    )
    got = tuples(quality.duplicate_files(df), "device", "file")
    assert got == [("dev", f) for f in expected] + [("other", f"o{f}") for f in expected]
