import json

import pytest
from pyspark.sql import functions as F

from meter_helpers import tuples, utc
from phasegrid.operators import joins, messages
from phasegrid.schema import LIVE_FIELDS, PHASES, TOTAL_FIELDS
from phasegrid.streaming import live


def meter():
    """A meter status in the protocol's keys; each phase value is 100 × phase + 1.5 × field."""
    phases = {f"{p}_{f}": 100.0 * i + 1.5 * k for i, p in enumerate(PHASES, 1) for k, f in enumerate(LIVE_FIELDS)}
    totals = {f"total_{f}": 1000.5 + i for i, f in enumerate(TOTAL_FIELDS)}
    return {"id": 0} | phases | {"n_current": None} | totals


def message(change=None, drop=(), **top):
    em = {k: v for k, v in (meter() | (change or {})).items() if k not in drop}
    return {
        "src": "meter-1", "dst": "client", "method": "NotifyStatus",
        "params": {"ts": 1700000000.25, "em:0": em},
    } | top


def parse(spark, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    raw = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    return messages.parse_messages(raw).orderBy("n")


def test_golden_message(spark):
    row = parse(spark, message()).first()
    assert (row.route, row.error, row.src) == ("status", None, "meter-1")
    assert row.timestamp == utc("2023-11-14T22:13:20.250000")
    assert [p.phase_name for p in row.status.phases] == list(PHASES)
    assert row.status.id == 0 and row.status.n_current is None
    assert row.status.phases[0].act_power == meter()["a_act_power"] and row.status.total_act_power == meter()["total_act_power"]
    assert row.status.errors == [] and row.status.n_errors == [] and row.status.phases[0].errors == []


@pytest.mark.parametrize(
    "document, route, error",
    [
        (message(method="NotifyEvent"), "ignored", None),
        ({"method": "NotifyEvent"}, "ignored", None),
        (message(params={"ts": 1.5, "sys": {}}), "ignored", None),
        (message(method="NotifyFullStatus"), "error", "unexpected method NotifyFullStatus"),
        ({"method": "NotifyStatus"}, "error", "missing params"),
        ("{broken", "error", "not a message with a method"),
        ("[1]", "error", "not a message with a method"),
        ("", "error", "not a message with a method"),
        ({"src": "meter-1"}, "error", "not a message with a method"),
        (message(drop=["c_pf"]), "error", "em:0: missing c_pf"),
        (message(drop=["n_current"]), "error", "em:0: missing n_current"),
        (message({"surplus": 1}), "error", "em:0: unknown surplus"),
        (message({"a_voltage": "high"}), "error", "em:0: value of wrong type"),
        (message({"a_voltage": None}), "status", None),
        (message(params={"ts": 1.5, "em:0": None}), "error", "em:0: not an object"),
        (message(params={"ts": 1.5, "em:0": 7}), "error", "em:0: not an object"),
        (message(params={"em:0": meter()}), "error", "missing or wrong ts"),
        (message(params={"ts": "soon", "em:0": meter()}), "error", "missing or wrong ts"),
        (message(params={"ts": "1700000000.25", "em:0": meter()}), "status", None),
        ({k: v for k, v in message().items() if k != "src"}, "error", "missing src"),
        (message({"a_errors": ["out_of_range:voltage"], "user_calibrated_phase": ["a"]}), "status", None),
    ],
)
def test_routing(spark, document, route, error):
    row = parse(spark, document).first()
    assert (row.route, row.error) == (route, error)
    assert (row.status is not None) == (route == "status")


def test_error_lists_and_calibration(spark):
    change = {"a_errors": ["out_of_range:voltage"], "errors": ["phase_sequence"], "user_calibrated_phase": ["a"]}
    status = parse(spark, message(change)).first().status
    assert status.phases[0].errors == ["out_of_range:voltage"] and status.errors == ["phase_sequence"]
    assert status.user_calibrated_phase == []


def test_a_document_is_parsed_once(spark):
    plan = parse(spark, message()).where("route = 'status'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_unknown_source_is_an_error(spark):
    raw = spark.createDataFrame([(json.dumps(message()),), (json.dumps(message(src="x")),)], "value string")
    devices = spark.createDataFrame([("meter-1", "kitchen")], "src string, device string")
    got = tuples(live.parse_events(raw, devices).fillna("-", ["device", "error"]), "route", "device", "error")
    assert got == [("error", "-", "unknown source x"), ("status", "kitchen", "-")]
    twice = devices.union(devices)
    with pytest.raises(Exception, match="Key is not unique"):
        live.parse_events(raw, twice).collect()


def snapshot(**parts):
    counters = {k: 1.5 * i for i, k in enumerate(messages.METER_DATA_FIELDS)} | {"id": 0}
    kinds = {"string": "x", "bigint": 7, "boolean": True}
    system = {k: kinds[t] for k, t in messages.SYSTEM_FIELDS.items()} | {"available_updates": {"stable": {"version": "1"}}}
    return {
        "temperature:0": {"id": 0, "tC": 41.5, "tF": 106.7}, "sys": system,
        "em:0": meter() | {"user_calibrated_phase": ["a"]}, "emdata:0": counters, "wifi": {"ssid": "x"}, "mqtt": 1,
    } | parts


def test_snapshots(spark):
    bad_system = {k: v for k, v in snapshot()["sys"].items() if k != "time"}
    documents = [
        snapshot(), snapshot(sys=bad_system), snapshot(**{"em:0": meter()}), snapshot(**{"temperature:0": {}}),
        snapshot(**{"emdata:0": snapshot()["emdata:0"] | {"errors": ["database_error"]}}), "nothing",
    ]
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "n int, value string")
    rows = messages.parse_snapshots(raw).orderBy("n").collect()
    assert [r.error for r in rows] == [
        None, "sys: missing time", "em:0: missing user_calibrated_phase", "temperature:0: missing tC", None,
        "temperature:0: missing tC",
    ]
    assert rows[0].temperature == 41.5 and rows[0].sys.unixtime == 7 and rows[0].sys.restart_required
    assert json.loads(rows[0].sys.available_updates) == {"stable": {"version": "1"}}
    assert rows[0].em.user_calibrated_phase == ["a"] and rows[0].emdata.errors == []
    assert rows[4].emdata.errors == ["database_error"] and rows[1].sys is None
    flat = messages.flatten_snapshots(messages.parse_snapshots(raw), ["n"]).orderBy("n").first()
    assert flat.c_voltage == meter()["c_voltage"] and flat.total_act == 1.5 * 7
    assert [c for c in flat.asDict() if c[:2] == "b_" and c[2:] in LIVE_FIELDS] == [f"b_{f}" for f in LIVE_FIELDS]


def test_record_blocks(spark):
    documents = [
        {"data_blocks": [{"ts": 60, "period": 60, "records": 2}, {"ts": 600, "period": 60, "records": 3}]},
        {"data_blocks": []}, {}, {"data_blocks": [{"ts": 1, "period": 60}]},
        {"data_blocks": [{"ts": "x", "period": 60, "records": 1}]},
    ]
    raw = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "n int, value string")
    got = messages.parse_record_blocks(raw).orderBy("n", "ts").collect()
    assert [(r.n, r.ts, r.records, r.error) for r in got] == [
        (0, 60, 2, None), (0, 600, 3, None), (2, None, None, "missing data_blocks"),
        (3, None, None, "block: missing records"), (4, None, None, "block: value of wrong type"),
    ]
    assert got[0].timestamp == utc("1970-01-01T00:01:00")


def test_device_info(spark):
    kinds = {"string": "x", "bigint": 3, "boolean": False}
    record = {k: kinds[t] for k, t in messages.DEVICE_INFO_FIELDS.items()} | {"auth_domain": None}
    documents = [record, record | {"more": 1}, {"name": "n"}, record | {"gen": "second"}]
    raw = spark.createDataFrame([(f"d{i}", json.dumps(d)) for i, d in enumerate(documents)], "device string, value string")
    rows = messages.parse_device_info(raw).orderBy("device").collect()
    assert rows[0].error is None and rows[0].info.gen == 3 and rows[0].info.auth_domain is None
    assert rows[1].error == "device info: unknown more" and rows[2].error.startswith("device info: missing id, mac")
    assert rows[3].error == "device info: value of wrong type"
    info = messages.parse_device_info(raw).where("error IS NULL").select("device", "info.*")
    joined = joins.attach_device_info(spark.createDataFrame([("d0",), ("d9",)], "device string"), info)
    assert tuples(joined.select("device", F.coalesce("device_info.gen", F.lit(-1)))) == [("d0", 3), ("d9", -1)]


def test_stand_alone_documents(spark):
    whole = snapshot()

    def rows(parse, *documents):
        raw = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "n int, value string")
        return parse(raw).orderBy("n").collect()

    system = rows(messages.parse_system_status, whole["sys"], {}, whole["sys"] | {"uptime": "long"})
    assert system[0].error is None and system[0].sys.unixtime == 7
    assert system[1].error.startswith("sys: missing") and system[2].error == "sys: value of wrong type" and system[2].sys is None
    meters = rows(messages.parse_meter_status, whole["em:0"], meter(), 5)
    assert meters[0].error is None and meters[0].em.total_current == meter()["total_current"]
    assert meters[1].error == "em: missing user_calibrated_phase" and meters[2].error == "em: not an object"
    counters = rows(messages.parse_meter_counters, whole["emdata:0"], whole["emdata:0"] | {"more": 1})
    assert counters[0].error is None and counters[0].emdata.errors == [] and counters[1].error == "emdata: unknown more"
