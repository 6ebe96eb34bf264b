"""For each registered query, SQL that gives the same rows from the same tables."""

from __future__ import annotations

from phasegrid.operators.messages import DEVICE_INFO_FIELDS, METER_DATA_FIELDS
from phasegrid.schema import (
    LIVE_FIELDS,
    MEASURES,
    NEUTRAL_MEASURES,
    PHASES,
    TOTAL_FIELDS,
    WEEKDAYS,
    WIDE_MEASURES,
)

_SCALE = {"a": 1.0, "b": 0.5, "c": 0.25}
_START, _STOP = "TIMESTAMP '2024-01-05 07:30:00'", "TIMESTAMP '2024-01-20 16:45:00'"


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_WIDE = ",\n  ".join(
    [
        (f"CASE WHEN event_type <> 'error' THEN value * {_number(s * (i + 1))} END" if p == "c"
         else f"value * {_number(s * (i + 1))}") + f" AS {p}_{m}"
        for p, s in _SCALE.items()
        for i, m in enumerate(MEASURES)
    ]
    + [
        f"CASE WHEN event_type <> 'error' THEN value * {_number(0.125 * (i + 1))} END AS n_{m}"
        for i, m in enumerate(NEUTRAL_MEASURES)
    ]
)
_READINGS = f"""readings AS (SELECT date_trunc('minute', ts) AS timestamp,
  {_WIDE},
  'dev' || (user_id % 3) AS device, event_type AS file, event_id AS pos FROM events)"""
_SHIPMENTS = """shipments AS (SELECT l_shipdate AS timestamp, l_quantity AS a_total_act_energy,
  l_extendedprice AS b_total_act_energy, l_discount AS c_total_act_energy,
  l_returnflag AS device, l_linestatus AS file, l_orderkey, l_linenumber FROM lineitem)"""


def _first(source: str = "readings", order: str = "file, pos", where: str = "TRUE") -> str:
    return f"""first_rows AS (SELECT * FROM {source} WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY device, timestamp ORDER BY {order}) = 1)"""


def _phases(source: str, index: str, columns: dict[str, str]) -> str:
    """Phase rows of ``source``; ``columns`` maps output names to measures."""
    return " UNION ALL ".join(
        f"SELECT {index}, '{p}' AS phase, "
        + ", ".join(f"{p}_{m} AS {name}" for name, m in columns.items())
        + f" FROM {source}"
        for p in PHASES
    )


_ENERGY_LONG = "long AS (" + _phases("first_rows", "timestamp, device, file", {"e": "total_act_energy"}) + ")"
_WITH_FIRST = f"WITH {_READINGS}, {_first()}"
_WITH_LONG = f"{_WITH_FIRST}, {_ENERGY_LONG}"


def _floor(micros: int, origin: str = "0") -> str:
    """Window start for a fixed length, counted from ``origin`` (epoch microseconds)."""
    ts = f"(epoch_us(timestamp) - {origin})"
    return f"make_timestamp({origin} + {micros} * CAST(floor(({ts}::HUGEINT)::DOUBLE / {micros}) AS BIGINT))"


_HOUR, _DAY = 3_600_000_000, 86_400_000_000


def _energy(start: str, groups: tuple[str, ...] = ("device", "phase"), with_: str = _WITH_LONG,
            source: str = "long", digits: int = 9, keep_start: bool = True, date: str = "window_start") -> str:
    keys = "".join(g + ", " for g in groups)
    kept = "window_start, " if keep_start else ""
    return f"""{with_}
SELECT {keys}{kept}CAST({date} AS DATE) AS date,
  round(coalesce(sum(e), 0) * CAST(0.001 AS DOUBLE), {digits}) AS total_act_energy_kwh
FROM (SELECT *, {start} AS window_start FROM {source}) GROUP BY {keys}window_start"""


_DAILY = f"""daily AS (SELECT device, phase, CAST(timestamp AS DATE) AS date,
  coalesce(sum(e), 0) * CAST(0.001 AS DOUBLE) AS kwh FROM long GROUP BY ALL)"""

_SHIPPED = (f"WITH {_SHIPMENTS}, long AS ("
            + _phases("shipments", "timestamp, device, file", {"e": "total_act_energy"}) + ")")

_LOCAL = "timezone('Europe/Berlin', timezone('UTC', {}))"
_FROM_LOCAL = "timezone('UTC', timezone('Europe/Berlin', {}))"


def _duration(seconds: str) -> str:
    return f"""(CASE WHEN {seconds} >= 86400 THEN CAST({seconds} // 86400 AS VARCHAR)
    || CASE WHEN {seconds} // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END
    || printf('%d:%02d:%02d', {seconds} % 86400 // 3600, {seconds} % 3600 // 60, {seconds} % 60))"""


def _stats(source: str, threshold: int) -> str:
    return f"""stats AS (SELECT device, count(*) AS total_rows, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
    epoch(max(timestamp)) - epoch(min(timestamp)) AS duration_s,
    count(*) FILTER (WHERE epoch(timestamp) - epoch(prev) > {threshold}) AS n_gaps
  FROM (SELECT *, lag(timestamp) OVER (PARTITION BY device ORDER BY timestamp) AS prev
        FROM (SELECT DISTINCT device, timestamp FROM {source})) GROUP BY device)"""


def _gaps(source: str, threshold: int) -> str:
    return f"""SELECT device, prev AS start, timestamp AS "end", epoch(timestamp) - epoch(prev) AS duration_s
FROM (SELECT *, lag(timestamp) OVER (PARTITION BY device ORDER BY timestamp) AS prev
      FROM (SELECT DISTINCT device, timestamp FROM {source}))
WHERE epoch(timestamp) - epoch(prev) > {threshold}"""


_FILES = """files AS (SELECT device, file, count(*) AS n_rows, min(timestamp) AS first_ts,
  max(timestamp) AS last_ts FROM {} GROUP BY device, file)"""
_DUPLICATES = """SELECT device, file, n_rows, first_ts, last_ts FROM (SELECT *,
    row_number() OVER w AS rn, first_value(last_ts) OVER w AS lead_last FROM files
  WINDOW w AS (PARTITION BY device ORDER BY first_ts, n_rows DESC, file))
WHERE rn > 1 AND first_ts <= lead_last AND last_ts <= lead_last"""


def _csv_points(source: str, factor: str = "1") -> str:
    """Wide points of ``source``."""
    parts = [
        f"SELECT 'em' AS measurement, device, 'csv' AS source, '{p}' AS phase, timestamp AS ts, "
        + ", ".join(f"{p}_{m} * {factor} AS {m}" for m in MEASURES) + f" FROM {source}"
        for p in PHASES
    ]
    parts.append(
        f"SELECT 'em', device, 'csv', 'neutral', timestamp, "
        + ", ".join(f"n_{m} * {factor}" if m in NEUTRAL_MEASURES else "NULL" for m in MEASURES)
        + f" FROM {source}"
    )
    return " UNION ALL ".join(parts)


def _field_values(points: str, fields: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT measurement, device, source, phase, ts, '{f}' AS field, {f} AS value "
        f"FROM {points} WHERE {f} IS NOT NULL"
        for f in fields
    )


_POINTS = f"{_WITH_FIRST}, points AS ({_csv_points('first_rows')})"
_POINTS_LONG = f"{_POINTS} {_field_values('points', MEASURES)}"
_TEXT = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"
_LINES = f"""{_POINTS} SELECT 'em,device=' || device || ',phase=' || phase || ',source=' || source || ' '
  || concat_ws(',', {', '.join(f"'{f}=' || {_TEXT.format(f)}" for f in sorted(MEASURES))})
  || ' ' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR) AS line
FROM points WHERE coalesce({', '.join(MEASURES)}) IS NOT NULL"""

_EVENT_SRC = "CASE WHEN user_id % 50 = 49 THEN 'stranger' ELSE 'meter-' || (user_id % 3) END"
_ACCEPTED = f"""accepted AS (SELECT event_id, ts, value, event_type, {_EVENT_SRC} AS src,
    'dev' || (user_id % 3) AS device FROM events
  WHERE event_type IN ('view', 'click') AND user_id % 50 <> 49)"""


def _live_points(source: str = "accepted", order: str = "epoch_us(ts) AS us, src") -> str:
    head = "SELECT 'em' AS measurement, device, 'live' AS source, '{}' AS phase, date_trunc('second', ts) AS ts"
    parts = [
        head.format(p) + ", " + ", ".join(f"value * {_number(s * (i + 1))} AS {f}" for i, f in enumerate(LIVE_FIELDS))
        + f", {order} FROM {source}"
        for p, s in _SCALE.items()
    ]
    neutral = {"current": f"value * {_number(0.125)}"}
    total = dict(zip(TOTAL_FIELDS, (f"value * {_number(x)}" for x in (1.75, 5.25, 7.0))))
    for phase, values, where in (("neutral", neutral, " WHERE event_type = 'click'"), ("total", total, "")):
        parts.append(
            head.format(phase) + ", " + ", ".join(values.get(f, "NULL") for f in LIVE_FIELDS)
            + f", {order} FROM {source}{where}"
        )
    return " UNION ALL ".join(parts)


_LIVE = f"WITH {_ACCEPTED}, points AS ({_live_points()})"
_LIVE_LATEST = f"""{_LIVE}, long AS (SELECT * FROM ({" UNION ALL ".join(
    f"SELECT measurement, device, source, phase, ts, us, src, '{f}' AS field, {f} AS value FROM points WHERE {f} IS NOT NULL"
    for f in LIVE_FIELDS)})
  QUALIFY row_number() OVER (PARTITION BY device, phase, ts, field ORDER BY us DESC, src DESC) = 1)"""
_LATEST_IN_PARTS = f"""WITH {_ACCEPTED}, points AS ({_live_points(order='epoch_us(ts) AS us, src, event_id % 3 = 0 AS late')})
SELECT measurement, device, source, phase, ts, field, value FROM ({" UNION ALL ".join(
    f"SELECT measurement, device, source, phase, ts, us, src, late, '{f}' AS field, {f} AS value FROM points WHERE {f} IS NOT NULL"
    for f in LIVE_FIELDS)})
  QUALIFY row_number() OVER (PARTITION BY device, phase, ts, field ORDER BY late DESC, us DESC, src DESC) = 1"""
_LATEST = f"{_LIVE_LATEST} SELECT measurement, device, source, phase, ts, field, value FROM long"


def _mean(with_: str, source: str, where: str, micros: int) -> str:
    window = f"make_timestamp({micros} * (epoch_us(ts) // {micros} + 1))"
    return f"""{with_} SELECT measurement, device, source, phase, field, least({window}, {_STOP}) AS time,
  round(avg(value), 6) AS value FROM {source}
WHERE ts >= {_START} AND ts < {_STOP} AND {where} GROUP BY ALL"""


_CSV_MEAN = (f"{_POINTS}, long AS ({_field_values('points', ('total_act_energy',))})", "long",
             "device IN ('dev0', 'dev1') AND phase IN ('a', 'b', 'c')")

_ERROR_CASE = """CASE WHEN event_type IN ('signup', 'purchase') THEN NULL
  WHEN event_type IN ('view', 'click') THEN CASE WHEN user_id % 50 = 49 THEN 'unknown source stranger' END
  WHEN user_id % 4 = 0 THEN 'unexpected method NotifyFullStatus'
  WHEN user_id % 4 = 1 THEN 'em:0: missing total_current'
  WHEN user_id % 4 = 2 THEN 'em:0: unknown surplus'
  ELSE 'not a message with a method' END"""
_ROUTED = f"""routed AS (SELECT event_id, {_ERROR_CASE} AS error,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'ignored' ELSE 'status' END AS kind FROM events)"""

_WEEKDAY = "CASE isodow({}) " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(WEEKDAYS, 1)) + " END"

_INFO = ", ".join(
    f"c_custkey + {i} AS {k}" if kind == "bigint" else f"c_custkey % 2 = 0 AS {k}" if kind == "boolean"
    else f"CAST(NULL AS VARCHAR) AS {k}" if k == "auth_domain" else f"c_name AS {k}"
    for i, (k, kind) in enumerate(DEVICE_INFO_FIELDS.items())
)

_FILLED = ", ".join(f"coalesce({m}, 0) AS {m}" for m in WIDE_MEASURES)


def _scaled(factor: str) -> str:
    return ", ".join(f"coalesce({m}, 0) * ({factor}) AS {m}" for m in WIDE_MEASURES)


def _origin(start: str, micros: int) -> str:
    return f"""make_timestamp({start} + {micros} * ((epoch_us(timestamp) - {start}) // {micros}))"""


_DATAPOINT = f"epoch_us(min(timestamp) OVER (PARTITION BY device))"
_DATAPOINT_ALL = "epoch_us(min(timestamp) OVER ())"

ORACLE_SQL: dict[str, str] = {
    "energy_daily": _energy("date_trunc('day', timestamp)"),
    "energy_hourly": _energy("date_trunc('hour', timestamp)"),
    "energy_weekly": _energy("CAST(date_trunc('week', timestamp) AS TIMESTAMP)"),
    "energy_monthly": _energy("CAST(date_trunc('month', timestamp) AS TIMESTAMP)"),
    "energy_quarterly": _energy("CAST(date_trunc('quarter', timestamp) AS TIMESTAMP)"),
    "energy_two_weeks": _energy(_floor(14 * _DAY, str(4 * _DAY))),
    "energy_grand_total": _energy("date_trunc('day', timestamp)", ()),
    "energy_by_device": _energy("date_trunc('day', timestamp)", ("device",)),
    "energy_by_phase": _energy("date_trunc('day', timestamp)", ("phase",)),
    "energy_by_file": _energy("CAST(date_trunc('week', timestamp) AS TIMESTAMP)", ("file", "device", "phase")),
    "energy_start_thursday": _energy(_floor(7 * _DAY)),
    "energy_from_datapoint": _energy(_origin(_DATAPOINT, 5 * _HOUR)),
    "energy_from_datapoint_all": _energy(_origin(_DATAPOINT_ALL, 7 * _HOUR), ()),
    "energy_local_days": _energy(
        _FROM_LOCAL.format(f"date_trunc('day', {_LOCAL.format('timestamp')})"),
        date=_LOCAL.format("window_start"),
    ),
    "energy_shipments_monthly": _energy(
        "CAST(date_trunc('month', timestamp) AS TIMESTAMP)", with_=_SHIPPED, digits=5
    ),
    "energy_shipments_weekly": _energy(
        "CAST(date_trunc('week', timestamp) AS TIMESTAMP)", with_=_SHIPPED, digits=5
    ),
    "energy_weekday": f"""{_WITH_LONG}, {_DAILY}
SELECT CAST(isodow(date) AS INTEGER) AS day_of_week_num, device, phase,
  round(avg(kwh), 9) AS total_act_energy_kwh, {_WEEKDAY.format('date')} AS day_of_week
FROM daily GROUP BY ALL""",
    "weekday_ordered": f"""{_WITH_LONG}, {_DAILY}
SELECT *, CAST(row_number() OVER (ORDER BY day_of_week_num, device, phase) AS INTEGER) AS place FROM (
  SELECT CAST(isodow(date) AS INTEGER) AS day_of_week_num, device, phase,
  round(avg(kwh), 9) AS total_act_energy_kwh, {_WEEKDAY.format('date')} AS day_of_week
FROM daily GROUP BY ALL)""",
    "energy_per_timestamp": f"""{_WITH_LONG} SELECT timestamp, round(coalesce(sum(e), 0), 6) AS total_act_energy
FROM long GROUP BY timestamp""",
    "energy_since_age": _energy(
        "date_trunc('day', timestamp)", keep_start=False,
        with_=f"WITH {_READINGS}, {_first(where=chr(34) + 'timestamp' + chr(34) + ' >= TIMESTAMP ' + chr(39) + '2024-01-17' + chr(39))}, {_ENERGY_LONG}",
    ),
    "energy_range": _energy(
        "date_trunc('day', timestamp)", keep_start=False,
        with_=f"WITH {_READINGS}, {_first(where=f'timestamp BETWEEN {_START} AND {_STOP}')}, {_ENERGY_LONG}",
    ),
    "csv_range": _energy(
        "date_trunc('day', timestamp)", keep_start=False,
        with_=f"WITH {_READINGS}, {_first(where=f'timestamp BETWEEN {_START} AND {_STOP}')}, {_ENERGY_LONG}",
    ),
    "dedup_first": f"{_WITH_FIRST} SELECT * FROM first_rows",
    "dedup_last": f"WITH {_READINGS}, {_first(order='file DESC, pos DESC')} SELECT * FROM first_rows",
    "dedup_shipments": f"WITH {_SHIPMENTS}, {_first('shipments', 'file, l_orderkey, l_linenumber')} SELECT * FROM first_rows",
    "import_counts": f"""WITH {_READINGS} SELECT device, count(*) AS total_rows,
  count(DISTINCT timestamp) AS unique_rows, count(DISTINCT file) AS n_files FROM readings GROUP BY device""",
    "phase_column": f"WITH {_READINGS} {_phases('readings', 'timestamp, device, file', {'total_act_energy': 'total_act_energy'})}",
    "phase_all": f"WITH {_READINGS} {_phases('readings', 'timestamp, device, file', {m: m for m in MEASURES})}",
    "nested_readings": f"""WITH {_READINGS} SELECT device, timestamp, 3 AS n_phases,
  {', '.join(f'{p}_{m}' for p in PHASES for m in MEASURES)}, {', '.join(f'n_{m}' for m in NEUTRAL_MEASURES)} FROM readings""",
    "time_range": f"""WITH {_READINGS} SELECT count(*) AS n_rows, min(timestamp) AS first_ts,
  max(timestamp) AS last_ts FROM readings""",
    "file_stats": f"WITH {_READINGS}, {_FILES.format('readings')} SELECT * FROM files",
    "device_stats": f"WITH {_READINGS}, {_stats('readings', 3600)} SELECT * FROM stats",
    "device_stats_shipments": f"WITH {_SHIPMENTS}, {_stats('shipments', 86400)} SELECT * FROM stats",
    "stats_line": f"""WITH {_READINGS}, {_stats('readings', 3600)}
SELECT device, 'Device ''' || device || ''' with ' || total_rows || ' rows from '
  || strftime({_LOCAL.format('first_ts')}, '%Y-%m-%d %H:%M') || ' to '
  || strftime({_LOCAL.format('last_ts')}, '%Y-%m-%d %H:%M') || ' ('
  || {_duration('CAST(duration_s AS BIGINT)')} || ') with ' || n_gaps || ' gaps' AS line FROM stats""",
    "file_line": f"""WITH {_READINGS}, {_FILES.format('readings')}
SELECT device, file, 'Device ''' || device || ''' / ' || file || ': '
  || strftime(first_ts, '%Y-%m-%d %H:%M:%S') || '+00:00 .. '
  || strftime(last_ts, '%Y-%m-%d %H:%M:%S') || '+00:00 (' || n_rows || ' rows)' AS line FROM files""",
    "gaps": f"WITH {_READINGS} {_gaps('readings', 3600)}",
    "gaps_minute": f"WITH {_READINGS} {_gaps('readings', 60)}",
    "gaps_shipments": f"WITH {_SHIPMENTS} {_gaps('shipments', 86400)}",
    "duplicate_files": f"WITH {_READINGS}, {_FILES.format('readings')} {_DUPLICATES}",
    "duplicate_files_many": f"""WITH source AS (SELECT ts AS timestamp, 'dev' || (user_id % 3) AS device,
  user_id || '/' || event_type AS file FROM events), {_FILES.format('source')} {_DUPLICATES}""",
    "device_phase_label": f"""{_WITH_LONG}, {_DAILY} SELECT date, round(kwh, 9) AS total_act_energy_kwh,
  device || '_' || phase AS device_phase FROM daily""",
    "top_days": f"""{_WITH_LONG}, {_DAILY} SELECT device, phase, date, round(kwh, 9) AS total_act_energy_kwh,
  device || '_' || phase AS device_phase FROM daily
ORDER BY total_act_energy_kwh DESC, device_phase, date LIMIT 10""",
    "points_csv": f"{_POINTS} SELECT * FROM points",
    "points_long": _POINTS_LONG,
    "line_protocol": _LINES,
    "line_protocol_file": _LINES,
    "points_table": _POINTS_LONG,
    "points_compacted": f"""{_POINTS}, doubled AS ({_csv_points('first_rows', '2')}),
  merged AS (SELECT * FROM points WHERE phase IN ('b', 'c')
    UNION ALL SELECT * FROM doubled WHERE phase IN ('a', 'neutral'))
{_field_values('merged', MEASURES)}""",
    "points_latest": _LATEST,
    "retention": f"{_POINTS} SELECT * FROM points WHERE ts >= TIMESTAMP '2024-01-16'",
    "windowed_mean": _mean(*_CSV_MEAN, 6 * _HOUR),
    "windowed_mean_stored": _mean(*_CSV_MEAN, 7 * _DAY),
    "windowed_mean_live": _mean(
        _LIVE_LATEST, "long", "field = 'act_power' AND phase IN ('a', 'b', 'c')", _HOUR
    ),
    "join_validated": f"""{_WITH_FIRST},
  energy AS ({_phases('first_rows', 'timestamp, device, file', {'total_act_energy': 'total_act_energy'})}),
  voltage AS ({_phases('first_rows', 'timestamp, device, file', {'max_voltage': 'max_voltage'})})
SELECT * FROM energy LEFT JOIN voltage USING (timestamp, device, file, phase)""",
    "device_join": """SELECT CAST(user_id AS VARCHAR) AS src, event_id, c_name AS device
FROM events LEFT JOIN customer ON user_id = c_custkey""",
    "device_info_join": f"""WITH info AS (SELECT c_custkey AS device, {_INFO} FROM customer)
SELECT event_id, user_id AS device, name, gen FROM events LEFT JOIN info ON user_id = device""",
    "messages_routed": f"""WITH {_ROUTED} SELECT event_id,
  CASE WHEN error IS NOT NULL THEN 'error' ELSE kind END AS route, error FROM routed""",
    "messages_typed": f"""WITH {_ACCEPTED} SELECT event_id, src, device, ts AS timestamp,
  CASE WHEN event_type = 'click' THEN value * {_number(0.125)} END AS n_current,
  value * {_number(1.0)} AS b_voltage, 0 AS n_errors, value * {_number(5.25)} AS total_act_power FROM accepted""",
    "messages_points": f"{_LIVE} {_field_values('points', LIVE_FIELDS)}",
    "snapshots": f"""SELECT event_id, value * {_number(0.5)} AS temperature, 'mac-' || user_id AS mac,
  event_id + 3 AS unixtime, event_id + 4 AS uptime,
  {', '.join(f'value * {_number(s * (i + 1))} AS {p}_{f}' for p, s in _SCALE.items() for i, f in enumerate(LIVE_FIELDS))},
  CASE WHEN event_type = 'click' THEN value * {_number(0.125)} END AS n_current,
  value * {_number(1.75)} AS total_current, value * {_number(5.25)} AS total_act_power,
  value * {_number(7.0)} AS total_aprt_power,
  {', '.join(f'value * {_number(i + 1.0)} AS {f}' for i, f in enumerate(METER_DATA_FIELDS[1:]))}
FROM events WHERE event_type <> 'error'""",
    "snapshots_rejected": "SELECT event_id, 'sys: missing uptime' AS error FROM events WHERE event_type = 'error'",
    "device_info": f"SELECT c_custkey AS device, CAST(NULL AS VARCHAR) AS error, {_INFO} FROM customer",
    "record_blocks": """WITH blocks AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) + shift AS ts,
    CAST(60 AS BIGINT) AS period, o_custkey % 1440 AS records FROM orders, (VALUES (0), (86400)) AS s(shift))
SELECT *, make_timestamp(ts * 1000000) AS timestamp FROM blocks""",
    "scalar_functions": f"""SELECT event_id, ts AS from_text, CAST(isodow(ts) AS INTEGER) AS weekday_num,
  {_WEEKDAY.format('ts')} AS weekday, strftime({_LOCAL.format('ts')}, '%Y-%m-%d %H:%M') AS local_time,
  {_TEXT.format('value * ' + _number(1e-5))} AS small_text, {_TEXT.format('value * ' + _number(1e6))} AS large_text,
  event_type AS kind, value AS number FROM events""",
    "csv_roundtrip": f"{_WITH_FIRST} SELECT timestamp, {_FILLED}, device FROM first_rows",
    "csv_import": f"""{_WITH_FIRST}, filled AS (SELECT timestamp, {_FILLED}, device FROM first_rows),
  points AS ({_csv_points('filled')}) {_field_values('points', MEASURES)}""",
    "stream_points": _LATEST,
    "stream_rejected": f"WITH {_ROUTED} SELECT error, count(*) AS n FROM routed WHERE error IS NOT NULL GROUP BY error",
    "stream_mean": f"""{_LIVE_LATEST} SELECT measurement, device, source, phase, field,
    make_timestamp({6 * _HOUR} * (epoch_us(ts) // {6 * _HOUR} + 1)) AS time, round(avg(value), 9) AS value
  FROM long WHERE field = 'act_power' AND phase IN ('a', 'b', 'c') GROUP BY ALL""",
    "stream_metrics": """SELECT 'failed' AS outcome, CAST(0 AS BIGINT) AS batches, CAST(0 AS BIGINT) AS input_rows,
  CAST(NULL AS BOOLEAN) AS timed, 'no room left' AS error
UNION ALL SELECT 'ended', 1, count(*), TRUE, NULL FROM events""",
    "stream_flushed": f"""{_LIVE_LATEST} SELECT measurement, device, source, phase, ts, field,
    CAST(1 AS BIGINT) AS n, TRUE AS merged, TRUE AS batches FROM long""",
    "write_outcomes": f"""{_POINTS}, live AS (SELECT count(DISTINCT (device, phase, ts)) AS points FROM ({_live_points("l")})),
  accepted AS (SELECT count(*) AS rows FROM l), stored AS (SELECT count(*) AS points, count(*) FILTER (phase = 'a') AS few FROM points)
SELECT 'live' AS batch, 1 AS attempt, 'error' AS outcome, CAST(0 AS BIGINT) AS points, CAST(NULL AS BIGINT) AS rows, 'no room left' AS error
UNION ALL SELECT 'live', 2, 'retry', points, rows, NULL FROM live, accepted
UNION ALL SELECT 'import-1', 1, 'success', points, NULL, NULL FROM stored
UNION ALL SELECT 'import-1', 2, 'retry', points, NULL, NULL FROM stored
UNION ALL SELECT 'import-2', 1, 'success', few, NULL, NULL FROM stored""".replace("WITH ", f"WITH {_ACCEPTED.replace('accepted AS', 'l AS', 1)}, ", 1),
    "csv_analysis": f"""{_WITH_FIRST} SELECT timestamp, {_scaled("CASE WHEN minute % 4 = 3 THEN 2 ELSE 1 END")}, device,
  CASE WHEN minute % 4 = 3 THEN 'b' ELSE 'a' END AS file FROM (SELECT *, epoch_us(timestamp) // 60000000 AS minute FROM first_rows)""",
    "csv_keep_last": f"""{_WITH_FIRST}, filled AS (SELECT timestamp, {_scaled("CASE WHEN minute % 4 = 1 THEN 1 ELSE 2 END")}, device
    FROM (SELECT *, epoch_us(timestamp) // 60000000 AS minute FROM first_rows)),
  points AS ({_csv_points('filled')}) {_field_values('points', MEASURES)}""",
    "store_two_streams": _LATEST,
    # Of two values of a second the one stored later counts: that of the events of the second part.
    "store_compact_then_stream": _LATEST_IN_PARTS,
    "store_rewrite_fewer_days": f"{_POINTS}, early AS (SELECT * FROM points WHERE ts < TIMESTAMP '2024-01-16') {_field_values('early', MEASURES)}",
    "store_open_range": f"{_POINTS}, later AS (SELECT * FROM points WHERE ts >= TIMESTAMP '2024-01-16') {_field_values('later', MEASURES)}",
    "points_registered": f"{_POINTS}, kept AS (SELECT * FROM points WHERE ts >= TIMESTAMP '2024-01-16') "
    f"SELECT *, CAST(1 AS BIGINT) AS partitions FROM ({_field_values('kept', MEASURES)})",
    "csv_bad_cell": f"""{_WITH_FIRST} SELECT device, timestamp,
    'b_max_voltage' || CASE WHEN epoch_us(timestamp) // 1000000 % 120 = 0 THEN ' n_avg_current' ELSE '' END AS columns, CAST(NULL AS DOUBLE) AS kwh
  FROM first_rows WHERE file = 'error'
  UNION ALL SELECT device, date_trunc('day', timestamp), NULL,
    round((sum(a_total_act_energy) + sum(b_total_act_energy) + sum(coalesce(c_total_act_energy, 0))) * CAST(0.001 AS DOUBLE), 9)
  FROM first_rows WHERE file <> 'error' GROUP BY ALL""",
    "system_status": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'sys: missing uptime' END AS error,
  CASE WHEN event_type <> 'error' THEN 'mac-' || user_id END AS mac,
  CASE WHEN event_type <> 'error' THEN event_id + 3 END AS unixtime,
  CASE WHEN event_type <> 'error' THEN event_id + 4 END AS uptime FROM events""",
    "meter_status": f"""SELECT event_id, CAST(NULL AS VARCHAR) AS error,
  CASE WHEN event_type = 'click' THEN value * {_number(0.125)} END AS n_current,
  value * {_number(1.75)} AS total_current, value * {_number(5.25)} AS total_act_power,
  value * {_number(7.0)} AS total_aprt_power FROM events""",
    "meter_counters": f"""SELECT event_id, CAST(NULL AS VARCHAR) AS error,
  {', '.join(f'value * {_number(i + 1.0)} AS {f}' for i, f in enumerate(METER_DATA_FIELDS[1:]))} FROM events""",
    "gap_lists": f"""WITH {_READINGS}, {_stats('readings', 3600)}, found AS ({_gaps('readings', 3600)})
SELECT device, n_gaps, CASE WHEN "start" IS NOT NULL THEN row_number() OVER (PARTITION BY device ORDER BY "start") - 1 END AS place,
  "start", "end" FROM stats LEFT JOIN found USING (device)""",
    "energy_local_hours": _energy("date_trunc('hour', timestamp)", ("device",), date=_LOCAL.format("window_start")),
}
