"""Routing, validation and typing of JSON documents sent by the meters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import epoch_micros_to_timestamp, epoch_to_timestamp
from phasegrid.schema import ERROR_LISTS, LIVE_FIELDS, PHASES, TOTAL_FIELDS

# Message kinds and document keys as the meters send them.
STATUS_METHOD = "NotifyStatus"
EVENT_METHOD = "NotifyEvent"
METER_KEY = "em:0"
METER_DATA_KEY = "emdata:0"
TEMPERATURE_KEY = "temperature:0"
METER_FIELDS = (
    ("id",)
    + tuple(f"{p}_{f}" for p in PHASES for f in LIVE_FIELDS)
    + ("n_current",)
    + tuple(f"total_{f}" for f in TOTAL_FIELDS)
)
CALIBRATION = "user_calibrated_phase"
METER_DATA_FIELDS = (
    "id",
    "a_total_act_energy",
    "a_total_act_ret_energy",
    "b_total_act_energy",
    "b_total_act_ret_energy",
    "c_total_act_energy",
    "c_total_act_ret_energy",
    "total_act",
    "total_act_ret",
)
SYSTEM_FIELDS = {
    "mac": "string",
    "restart_required": "boolean",
    "time": "string",
    "unixtime": "bigint",
    "uptime": "bigint",
    "ram_size": "bigint",
    "ram_free": "bigint",
    "fs_size": "bigint",
    "fs_free": "bigint",
    "cfg_rev": "bigint",
    "kvs_rev": "bigint",
    "schedule_rev": "bigint",
    "webhook_rev": "bigint",
    "available_updates": "string",
    "reset_reason": "bigint",
    "last_sync_ts": "bigint",
    "ram_min_free": "bigint",
    "btrelay_rev": "bigint",
}
DEVICE_INFO_FIELDS = {
    "name": "string",
    "id": "string",
    "mac": "string",
    "slot": "bigint",
    "key": "string",
    "batch": "string",
    "fw_sbits": "string",
    "model": "string",
    "gen": "bigint",
    "fw_id": "string",
    "ver": "string",
    "app": "string",
    "auth_en": "boolean",
    "auth_domain": "string",
    "profile": "string",
}
BLOCK_FIELDS = {"ts": "bigint", "period": "bigint", "records": "bigint"}


def _keys(document: Column, path: str) -> Column:
    """The keys of the object at ``path``; null if there is no object."""
    return F.map_keys(F.try_variant_get(document, path, "map<string,variant>"))


_WRONG = "_wrong"


def _fields(types: dict[str, str]) -> str:
    return ", ".join(f"`{key}`: {kind}" for key, kind in types.items())


def _parse(text: str | Column, fields: str) -> Column:
    """The typed parts of a document; ``_wrong`` is set if any value has another type."""
    column = F.col(text) if isinstance(text, str) else text
    return F.from_json(
        column, f"struct<{fields}, {_WRONG}: string>", {"columnNameOfCorruptRecord": _WRONG}
    )


def object_error(
    keys: Column, name: str, types: dict[str, str], optional: Sequence[str] = ()
) -> Column:
    """Why an object with ``keys`` is rejected; null if it has just those of ``types``.

    A key with the value null counts as present.
    """
    known = F.array(*[F.lit(k) for k in types])
    missing = F.array_except(F.array(*[F.lit(k) for k in types if k not in optional]), keys)
    unknown = F.array_except(keys, known)
    return (
        F.when(keys.isNull(), F.lit(f"{name}: not an object"))
        .when(F.size(missing) > 0, F.concat(F.lit(f"{name}: missing "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit(f"{name}: unknown "), F.array_join(unknown, ", ")))
    )


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` so that later filters on them do not repeat their computation.

    Catalyst pushes a filter below a projection by copying the filtered expressions, which would
    parse every document twice. It does not push one below a generator, so the finished columns
    pass through one.
    """
    done = {f"_done_{name}": column for name, column in columns.items()}
    row = F.struct(*[F.col(f"_done_{name}").alias(name) for name in columns])
    return df.withColumns(done).select(*df.columns, F.inline(F.array(row)))


_METER_TYPES = {
    **{key: "bigint" if key == "id" else "double" for key in METER_FIELDS},
    **{key: "array<string>" for key in (*ERROR_LISTS, CALIBRATION)},
}
_METER_DATA_TYPES = {
    **{key: "bigint" if key == "id" else "double" for key in METER_DATA_FIELDS},
    "errors": "array<string>",
}


def _or_empty(strings: Column) -> Column:
    return F.coalesce(strings, F.array().cast("array<string>"))


def meter_status(obj: Column, *, keep_calibration: bool) -> Column:
    """A flat meter status as a struct with an array of three phases; missing error lists are empty."""
    phases = F.array(
        *[
            F.struct(
                F.lit(p).alias("phase_name"),
                *[obj[f"{p}_{f}"].alias(f) for f in LIVE_FIELDS],
                _or_empty(obj[f"{p}_errors"]).alias("errors"),
            )
            for p in PHASES
        ]
    )
    calibration = obj[CALIBRATION] if keep_calibration else F.lit(None)
    return F.struct(
        obj["id"].alias("id"),
        phases.alias("phases"),
        obj["n_current"].alias("n_current"),
        _or_empty(obj["n_errors"]).alias("n_errors"),
        *[obj[f"total_{f}"].alias(f"total_{f}") for f in TOTAL_FIELDS],
        _or_empty(calibration).alias(CALIBRATION),
        _or_empty(obj["errors"]).alias("errors"),
    )


def parse_messages(raw: DataFrame, text: str = "value") -> DataFrame:
    """Type and route notifications.

    Adds ``route`` (``status``, ``ignored`` or ``error``), ``error`` (the reason), ``src``,
    ``timestamp`` and the nested ``status``; the latter three are null unless the route is
    ``status``. Text that is no JSON is an error row like any other.
    """
    document = F.col("_d")
    fields = f"method: string, src: string, params: struct<ts: string, `{METER_KEY}`: struct<{_fields(_METER_TYPES)}>>"
    step = raw.withColumns({"_d": F.try_parse_json(text), "_m": _parse(text, fields)}).withColumns(
        {
            "_method": F.try_variant_get(document, "$.method", "string"),
            "_params": _keys(document, "$.params"),
            "_em_keys": _keys(document, f"$.params['{METER_KEY}']"),
            "_ts": epoch_micros_to_timestamp(F.col("_m.params.ts")),
        }
    )
    method, params, em = F.col("_method"), F.col("_params"), F.col("_m.params")[METER_KEY]
    error = (
        F.when(method.isNull(), F.lit("not a message with a method"))
        .when(method == EVENT_METHOD, F.lit(None))
        .when(method != STATUS_METHOD, F.concat(F.lit("unexpected method "), method))
        .when(params.isNull(), F.lit("missing params"))
        .when(~F.array_contains(params, METER_KEY), F.lit(None))
        .otherwise(
            F.coalesce(
                object_error(F.col("_em_keys"), METER_KEY, _METER_TYPES, (*ERROR_LISTS, CALIBRATION)),
                F.when(F.col("_ts").isNull(), F.lit("missing or wrong ts")),
                F.when(F.col("_m.src").isNull(), F.lit("missing src")),
                F.when(F.col(f"_m.{_WRONG}").isNotNull(), F.lit(f"{METER_KEY}: value of wrong type")),
            )
        )
    )
    step = compute_once(step, {"error": error})
    has_status = (method == STATUS_METHOD) & F.array_contains(params, METER_KEY)
    route = F.when(F.col("error").isNotNull(), "error").when(has_status, "status").otherwise("ignored")
    accepted = F.col("error").isNull() & has_status
    return step.select(
        *raw.columns,
        route.alias("route"),
        "error",
        F.when(accepted, F.col("_m.src")).alias("src"),
        F.when(accepted, F.col("_ts")).alias("timestamp"),
        F.when(accepted, meter_status(em, keep_calibration=False)).alias("status"),
    )


def parse_snapshots(raw: DataFrame, text: str = "value") -> DataFrame:
    """Full device status documents: temperature, system, meter and energy counters, typed.

    ``error`` tells why a document was rejected; its typed columns are null then.
    """
    parts = {
        "sys": SYSTEM_FIELDS,
        METER_KEY: _METER_TYPES,
        METER_DATA_KEY: _METER_DATA_TYPES,
        TEMPERATURE_KEY: {"tC": "double"},
    }
    fields = ", ".join(f"`{part}`: struct<{_fields(types)}>" for part, types in parts.items())
    step = raw.withColumns({"_d": F.try_parse_json(text), "_m": _parse(text, fields)}).withColumns(
        {f"_keys_{part}": _keys(F.col("_d"), f"$['{part}']") for part in parts}
    )
    system, em, emdata, temperature = (F.col("_m")[part] for part in parts)
    keys = {part: F.col(f"`_keys_{part}`") for part in parts}
    has_temperature = F.array_contains(keys[TEMPERATURE_KEY], "tC")
    error = F.coalesce(
        F.when(~F.coalesce(has_temperature, F.lit(False)), F.lit(f"{TEMPERATURE_KEY}: missing tC")),
        object_error(keys["sys"], "sys", SYSTEM_FIELDS),
        object_error(keys[METER_KEY], METER_KEY, _METER_TYPES, ERROR_LISTS),
        object_error(keys[METER_DATA_KEY], METER_DATA_KEY, _METER_DATA_TYPES, ["errors"]),
        F.when(F.col(f"_m.{_WRONG}").isNotNull(), F.lit("document: value of wrong type")),
    )
    step = compute_once(step, {"error": error})
    good = F.col("error").isNull()
    counters = F.struct(
        *[emdata[key].alias(key) for key in METER_DATA_FIELDS], _or_empty(emdata["errors"]).alias("errors")
    )
    return step.select(
        *raw.columns,
        "error",
        F.when(good, temperature["tC"]).alias("temperature"),
        F.when(good, system).alias("sys"),
        F.when(good, meter_status(em, keep_calibration=True)).alias("em"),
        F.when(good, counters).alias("emdata"),
    )


def _single(raw: DataFrame, text: str, name: str, types: dict[str, str], optional: Sequence[str], made) -> DataFrame:
    """One object per document, typed as ``name``; ``error`` tells why a document was rejected."""
    step = raw.withColumns({"_d": _parse(text, _fields(types)), "_keys": _keys(F.try_parse_json(text), "$")})
    error = F.coalesce(
        object_error(F.col("_keys"), name, types, optional),
        F.when(F.col(f"_d.{_WRONG}").isNotNull(), F.lit(f"{name}: value of wrong type")),
    )
    step = compute_once(step, {"error": error})
    return step.select(*raw.columns, "error", F.when(F.col("error").isNull(), made(F.col("_d"))).alias(name))


def parse_system_status(raw: DataFrame, text: str = "value") -> DataFrame:
    """Stand-alone system status documents as the struct ``sys``."""
    return _single(raw, text, "sys", SYSTEM_FIELDS, (), lambda d: F.struct(*[d[k].alias(k) for k in SYSTEM_FIELDS]))


def parse_meter_status(raw: DataFrame, text: str = "value") -> DataFrame:
    """Stand-alone meter status documents as the struct ``em``."""
    return _single(raw, text, "em", _METER_TYPES, ERROR_LISTS, lambda d: meter_status(d, keep_calibration=True))


def parse_meter_counters(raw: DataFrame, text: str = "value") -> DataFrame:
    """Stand-alone energy counter documents as the struct ``emdata``."""

    def counters(d: Column) -> Column:
        return F.struct(*[d[k].alias(k) for k in METER_DATA_FIELDS], _or_empty(d["errors"]).alias("errors"))

    return _single(raw, text, "emdata", _METER_DATA_TYPES, ["errors"], counters)


def flatten_snapshots(snapshots: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One flat row per accepted snapshot: temperature, clock, per-phase and total values."""
    em, emdata = F.col("em"), F.col("emdata")
    return snapshots.where("error IS NULL").select(
        *keep,
        "temperature",
        F.col("sys.mac").alias("mac"),
        F.col("sys.unixtime").alias("unixtime"),
        F.col("sys.uptime").alias("uptime"),
        *[em["phases"][i][f].alias(f"{p}_{f}") for i, p in enumerate(PHASES) for f in LIVE_FIELDS],
        em["n_current"].alias("n_current"),
        *[em[f"total_{f}"].alias(f"total_{f}") for f in TOTAL_FIELDS],
        *[emdata[f].alias(f) for f in METER_DATA_FIELDS if f != "id"],
    )


def parse_device_info(raw: DataFrame, text: str = "value") -> DataFrame:
    """Device information records, typed; ``error`` tells why a record was rejected."""
    step = raw.withColumns(
        {"_d": _parse(text, _fields(DEVICE_INFO_FIELDS)), "_keys": _keys(F.try_parse_json(text), "$")}
    )
    error = F.coalesce(
        object_error(F.col("_keys"), "device info", DEVICE_INFO_FIELDS),
        F.when(F.col(f"_d.{_WRONG}").isNotNull(), F.lit("device info: value of wrong type")),
    )
    step = compute_once(step, {"error": error})
    info = F.struct(*[F.col("_d")[key].alias(key) for key in DEVICE_INFO_FIELDS])
    return step.select(*raw.columns, "error", F.when(F.col("error").isNull(), info).alias("info"))


def parse_record_blocks(raw: DataFrame, text: str = "value") -> DataFrame:
    """One row per stored data block: start, epoch seconds, period and number of records.

    A document without a block list, or a block with wrong keys, gives a row with ``error`` set.
    """
    blocks = F.try_variant_get(F.try_parse_json(text), "$.data_blocks", "array<variant>")
    step = raw.withColumn("_list", blocks)
    # An empty list has no rows; a missing one has an error row.
    none = F.array(F.lit(None).cast("variant"))
    step = step.select(
        *raw.columns, F.col("_list").isNull().alias("_none"), F.explode(F.coalesce("_list", none)).alias("_b")
    )
    step = step.withColumns(
        {
            "_t": _parse(F.to_json("_b"), _fields(BLOCK_FIELDS)),
            "_keys": _keys(F.col("_b"), "$"),
        }
    )
    error = F.when(F.col("_none"), F.lit("missing data_blocks")).otherwise(
        F.coalesce(
            object_error(F.col("_keys"), "block", BLOCK_FIELDS),
            F.when(F.col(f"_t.{_WRONG}").isNotNull(), F.lit("block: value of wrong type")),
        )
    )
    step = compute_once(step, {"error": error})
    good = F.col("error").isNull()
    fields = [F.when(good, F.col("_t")[key]).alias(key) for key in BLOCK_FIELDS]
    return step.select(*raw.columns, "error", *fields).withColumn(
        "timestamp", epoch_to_timestamp(F.col("ts"))
    )
