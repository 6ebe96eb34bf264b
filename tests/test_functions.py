import datetime as dt

import pytest
from pyspark.sql import functions as F

from meter_helpers import utc
from phasegrid import functions as pf

NOW = utc("2031-02-03T04:05:06")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "age, delta",
    [
        ("all", None),
        ("ALL", None),
        ("max", dt.timedelta(days=60, hours=12)),
        ("MAX", dt.timedelta(days=60, hours=12)),
        ("5w", dt.timedelta(days=35)),
        ("12W", dt.timedelta(days=84)),
        ("9d", dt.timedelta(hours=216)),
        ("0D", dt.timedelta(0)),
        ("48h", dt.timedelta(days=2)),
        ("7H", dt.timedelta(minutes=420)),
    ],
)
def test_age(age, delta):
    assert pf.parse_age(age, NOW) == (None if delta is None else NOW - delta)


@pytest.mark.parametrize("age", ["never", "", "14", "8y", "5weeks", "-2d"])
def test_age_invalid(age):
    with pytest.raises(ValueError, match="is no age"):
        pf.parse_age(age, NOW)


@pytest.mark.parametrize("every", ["", "1", "d", "0d", "1d2", "1mo2d", "1d12h", "1ns", dt.timedelta(0)])
def test_every_invalid(every):
    with pytest.raises(ValueError):
        pf.parse_every(every)


@pytest.mark.parametrize(
    "every, ts, start",
    [
        ("1h30m", "2024-01-01T02:10:00", "2024-01-01T01:30:00"),
        ("1d", "2024-02-29T23:59:59.999999", "2024-02-29T00:00:00"),
        ("1d", "1969-12-31T12:00:00", "1969-12-31T00:00:00"),
        ("1w", "2024-01-07T23:59:59", "2024-01-01T00:00:00"),
        ("1w", "2024-01-08T00:00:00", "2024-01-08T00:00:00"),
        ("1mo", "2024-02-29T12:00:00", "2024-02-01T00:00:00"),
        ("2mo", "2024-12-31T12:00:00", "2024-11-01T00:00:00"),
        ("1q", "2024-05-05T00:00:00", "2024-04-01T00:00:00"),
        ("1y", "2024-05-05T00:00:00", "2024-01-01T00:00:00"),
        (dt.timedelta(days=7), "2024-01-08T00:00:00", "2024-01-04T00:00:00"),
    ],
)
def test_bucket(spark, every, ts, start):
    assert value(spark, pf.bucket(F.lit(ts).cast("timestamp"), every)) == utc(start)


@pytest.mark.parametrize(
    "every, origin, ts, start",
    [
        ("5h", "2024-01-01T01:10:00", "2024-01-01T06:09:59", "2024-01-01T01:10:00"),
        ("5h", "2024-01-01T01:10:00", "2024-01-01T06:10:00", "2024-01-01T06:10:00"),
        ("1mo", "2024-01-31T06:00:00", "2024-02-29T05:00:00", "2024-01-31T06:00:00"),
        ("1mo", "2024-01-31T06:00:00", "2024-02-29T06:00:00", "2024-02-29T06:00:00"),
        ("2mo", "2024-01-15T00:00:00", "2024-04-20T00:00:00", "2024-03-15T00:00:00"),
    ],
)
def test_bucket_from_origin(spark, every, origin, ts, start):
    column = pf.bucket(F.lit(ts).cast("timestamp"), every, origin=F.lit(origin).cast("timestamp"))
    assert value(spark, column) == utc(start)


def test_bucket_in_local_time(spark):
    summer = pf.bucket(F.lit("2024-07-01T22:30:00").cast("timestamp"), "1d", tz="Europe/Berlin")
    winter = pf.bucket(F.lit("2024-01-01T22:30:00").cast("timestamp"), "1d", tz="Europe/Berlin")
    assert value(spark, summer) == utc("2024-07-01T22:00:00")
    assert value(spark, winter) == utc("2023-12-31T23:00:00")


@pytest.mark.parametrize(
    "number, text",
    [
        (10.1, "10.1"), (1.0, "1"), (0.0, "0"), (-2.5, "-2.5"), (0.0069, "0.0069"), (0.0001, "0.0001"),
        (0.00012345, "0.00012345"), (1e-5, "1e-05"), (1.5e-7, "1.5e-07"), (12345678.0, "12345678"),
        (123456789.25, "123456789.25"), (1e15, "1000000000000000"), (1e16, "1e+16"), (1.5e18, "1.5e+18"),
        (float("nan"), None), (float("inf"), None),
    ],
)
def test_number_text(spark, number, text):
    assert value(spark, pf.number_text(F.lit(number))) == text


@pytest.mark.parametrize(
    "end, text",
    [
        ("2024-01-01T00:00:00", "0:00:00"),
        ("2024-01-01T01:02:03.5", "1:02:03.500000"),
        ("2024-01-02T00:00:00", "1 day, 0:00:00"),
        ("2024-01-30T23:58:00", "29 days, 23:58:00"),
    ],
)
def test_duration_text(spark, end, text):
    start = F.lit("2024-01-01T00:00:00").cast("timestamp")
    assert value(spark, pf.duration_text(start, F.lit(end).cast("timestamp"))) == text
    assert str(utc(end) - utc("2024-01-01T00:00:00")) == text


def test_time_texts(spark):
    ts = F.lit("2024-05-24T14:26:24.74").cast("timestamp")
    assert value(spark, pf.local_text(ts, "Europe/Berlin")) == "2024-05-24 16:26"
    assert value(spark, pf.utc_text(ts)) == "2024-05-24 14:26:24.740000+00:00"
    assert value(spark, pf.epoch_micros_to_timestamp(F.lit("1700000000.25"))) == utc("2023-11-14T22:13:20.250000")
    assert value(spark, pf.epoch_to_timestamp(F.lit(1649906400))) == utc("2022-04-14T03:20:00")


def test_strict_functions(spark):
    assert value(spark, pf.one_of(F.lit("a"), "abc")) == "a"
    assert value(spark, pf.weekday_name(F.lit(7))) == "Sunday"
    assert value(spark, pf.strict_number(F.lit("1.5"))) == 1.5
    for column in (pf.one_of(F.lit("x"), "abc"), pf.weekday_name(F.lit(8)), pf.strict_number(F.lit(""))):
        with pytest.raises(Exception, match="domain|mapping|Not a number"):
            value(spark, column)


def test_label_propagates_null(spark):
    assert value(spark, pf.device_phase(F.lit("dev"), F.lit("a"))) == "dev_a"
    assert value(spark, pf.device_phase(F.lit("dev"), F.lit(None).cast("string"))) is None
