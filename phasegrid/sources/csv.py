"""CSV readings of many devices in one scan."""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.functions import epoch_to_timestamp
from phasegrid.operators.filters import epoch_micros
from phasegrid.schema import CSV_SCHEMA

_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


@dataclass(frozen=True)
class DeviceSource:
    """The folder that holds the CSV files of one device."""

    data_dir: str
    device: str


#: What to do with a row that has a value that cannot be read, a wrong number of cells, or no time.
IGNORE, FAIL, SET_ASIDE = "null", "fail", "set aside"
_BAD = "_bad"
REJECTED = ("device", "file", "columns", "line")


def load_readings(
    spark: SparkSession,
    sources: Sequence[DeviceSource],
    strict: bool = False,
    any_order: bool = True,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    missing: str = FAIL,
    bad: str = IGNORE,
) -> DataFrame | None:
    """All rows of all devices: the CSV columns, ``device``, ``file`` and ``pos``.

    ``strict`` fails the query on any missing or unparsable value, as an import must. Otherwise an empty
    cell is null, and ``bad`` tells what becomes of a row that cannot be read: its values are null
    (``null``), the query fails and names device, file and columns (``fail``), or the row is left out
    (``set aside``; ``rejected_readings`` has it). The latter two read every column, whatever the query
    uses, and make a file without rows an error. ``any_order`` allows files whose columns stand in another
    order; it costs one short read per file. Without it Spark checks each header during the scan.
    ``start`` and ``end``, both included, reach the scan as bounds of the raw timestamp. ``missing`` tells
    what a device without files means: ``fail``, or ``skip``, which leaves it out and gives None if no
    device has any.
    """
    rows = _of_devices(spark, sources, strict, any_order, missing, start, end, bad)
    if rows is None or bad == IGNORE:
        return rows if rows is None else rows.select(*_columns())
    if bad == SET_ASIDE:
        # A good row has no unread columns; asking for them keeps every column in the scan.
        good = F.col(_BAD).isNull() & F.col("timestamp").isNotNull() & (F.size(_unread(CSV_SCHEMA)) == 0)
        return rows.where(good).select(*_columns())
    untimed = F.concat(F.lit("No time in a row of "), "file", F.lit(", device "), "device")
    named = F.coalesce(F.nullif(F.array_join(_unread(CSV_SCHEMA), ", "), F.lit("")), F.lit("the number of cells"))
    message = F.concat(F.lit("Cannot read "), named, F.lit(" in a row of "), "file", F.lit(", device "), "device")
    wrong = (
        F.when(F.col("timestamp").isNull(), F.raise_error(untimed).cast("boolean"))
        .when(F.col(_BAD).isNotNull(), F.raise_error(message).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return rows.where(wrong).select(*_columns())


def rejected_readings(
    spark: SparkSession,
    sources: Sequence[DeviceSource],
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
) -> DataFrame:
    """The rows that cannot be read: device, file, the names of the unreadable columns (none: a wrong number of cells), line."""
    rows = _of_devices(spark, sources, False, True, FAIL, start, end, SET_ASIDE)
    none = F.col("timestamp").isNull()
    columns = F.array_distinct(F.concat(F.when(none, F.array(F.lit("timestamp"))).otherwise(F.array().cast("array<string>")), _unread(CSV_SCHEMA)))
    rejected = rows.where(F.col(_BAD).isNotNull() | none)
    return rejected.select("device", "file", columns.alias("columns"), F.col(_BAD).alias("line"))


def _unread(schema: T.StructType) -> Column:
    """The columns of a bad row whose cells hold a text but no value; naming all keeps all in the scan."""
    columns = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNull().alias("none")) for c in schema.names])
    lost = F.zip_with(F.split(_BAD, ","), columns, lambda cell, c: F.when(c["none"] & (F.trim(cell) != ""), c["name"]))
    return F.coalesce(F.array_compact(lost), F.array().cast("array<string>"))


def _of_devices(
    spark: SparkSession, sources: Sequence[DeviceSource], strict: bool, any_order: bool, missing: str, start, end, bad: str
) -> DataFrame | None:
    """All rows with their device, and with ``_bad`` unless bad rows do not matter."""
    if not sources:
        raise ValueError("At least one device folder is needed")
    folders = defaultdict(list)
    paths: dict[str, str] = {}
    for source in sources:
        folder = _plain(source.data_dir)
        if paths.setdefault(folder, str(source.data_dir)) != str(source.data_dir):
            raise ValueError(f"Data dirs differ only in scheme or host: {folder}")
        folders[folder].append(source.device)
    if missing == "skip":
        paths = {folder: root for folder, root in paths.items() if _exists(spark, root)}
        folders = {folder: folders[folder] for folder in paths}
        if not paths:
            return None
    index = file_index(spark, list(paths.values()), any_order or bad != IGNORE)
    faults = index_faults(index, list(paths.values()), CSV_SCHEMA, bad != IGNORE)
    for folder, devices in list(folders.items()):
        if folder not in faults.folders:
            if missing != "skip":
                raise ValueError(f"No CSV files for {', '.join(map(repr, devices))} in {folder}")
            del folders[folder], paths[folder]
    if not folders:
        return None
    faults.fail()
    reordered = index if faults.reordered and any_order else None
    rows = _read(spark, list(paths.values()), CSV_SCHEMA, strict, start, end, bad != IGNORE, reordered)
    pairs = [(folder, device) for folder, devices in folders.items() for device in devices]
    if len(pairs) == 1:
        return rows.withColumn("device", F.lit(pairs[0][1]))
    dim = spark.createDataFrame(pairs, "_folder string, device string")
    return rows.withColumn("_folder", _folder_of(F.col("file"))).join(dim, "_folder")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_csv_dir(spark: SparkSession, source: DeviceSource, strict: bool = False) -> DataFrame:
    """All rows of the ``*.csv`` files directly in one device folder."""
    return load_readings(spark, [source], strict)


def load_csv_files(
    spark: SparkSession,
    files: Sequence[str],
    device: str,
    strict: bool = False,
    any_order: bool = True,
    schema: T.StructType = CSV_SCHEMA,
) -> DataFrame:
    """All rows of the given files, with provenance."""
    if not files:
        raise ValueError("At least one file is needed")
    index = file_index(spark, list(files), any_order)
    reordered = None
    if any_order:
        faults = index_faults(index, list(files), schema, False)
        faults.fail()
        reordered = index if faults.reordered else None
    rows = _read(spark, list(files), schema, strict, reordered=reordered)
    return rows.withColumn("device", F.lit(device)).select(*_columns(schema))


def _columns(schema: T.StructType = CSV_SCHEMA) -> list[str]:
    return [*schema.names, "device", "file", "pos"]


def file_index(spark: SparkSession, roots: Sequence[str], headers: bool = True) -> DataFrame:
    """The CSV files right in ``roots`` as a table: file, folder, header, has_rows; the latter two only with ``headers``.

    Spark lists the files, but leaves out those of no bytes; the tasks read the beginning of each, or, from a
    store that only Spark can open, Spark's text reader does.
    """
    listed = _listed(spark, roots)
    files = listed.select("path", _without_host(F.col("path")).alias("file")).withColumn("folder", _folder_of(F.col("file")))
    if not headers:
        return files.select("file", "folder", F.lit("").alias("header"), F.lit(True).alias("has_rows"))
    if all(_opens(r) for r in roots):
        schema = "path string, file string, folder string, header string, has_rows boolean"
        return files.mapInPandas(_beginnings, schema).drop("path")
    lines = spark.read.option("pathGlobFilter", "*.csv").text([_literal(r) for r in roots]).select(
        _file_path().alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.rtrim("value").alias("value"),
    )
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), (F.count_if(F.col("value") != "") > 1).alias("has_rows"))
    found = files.join(first, "file", "left")
    return found.select("file", "folder", F.nullif("header", F.lit("")).alias("header"), F.coalesce("has_rows", F.lit(False)).alias("has_rows"))


def _listed(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load([_literal(r) for r in roots])


def _file_without_bytes(spark: SparkSession, roots: Sequence[str]) -> str | None:
    """The first CSV file in ``roots`` that has no bytes."""
    for root in roots:
        where = spark._jvm.org.apache.hadoop.fs.Path(str(root))
        for found in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where):
            name = found.getPath().getName()
            if found.isFile() and found.getLen() == 0 and name.endswith(".csv") and name[0] not in "._":
                return _plain(str(found.getPath().toString()))
    return None


def _names(header: Column) -> Column:
    return F.transform(F.split(header, ","), lambda name: F.btrim(F.btrim(name), F.lit('"')))


@dataclass(frozen=True)
class IndexFaults:
    """What is wrong with the files of an index: an example of each kind, the folders that have files, how many are reordered."""

    folders: set[str]
    reordered: int
    example: str | None

    def fail(self) -> None:
        if self.example is not None:
            raise ValueError(self.example)


def index_faults(index: DataFrame, roots: Sequence[str], schema: T.StructType, need_rows: bool) -> IndexFaults:
    """Look through an index in one pass; one row per folder comes back."""
    spark = index.sparkSession
    wanted, header = F.array(*map(F.lit, schema.names)), F.col("header")
    names = _names(header)
    # Without headers there is nothing to compare.
    read = header != ""
    differ = read & (F.array_sort(names) != F.lit(sorted(schema.names)))
    rows = index.groupBy("folder").agg(
        F.min(F.when(header.isNull(), F.col("file"))).alias("bare"),
        F.min(F.when(differ, F.struct("file", "header"))).alias("differs"),
        F.min(F.when(header.isNotNull() & ~F.col("has_rows"), F.col("file"))).alias("empty"),
        F.count_if(read & (names != wanted)).alias("reordered"),
        F.count(F.lit(1)).alias("files"),
    ).collect()
    example = None
    # Spark's listing knows files of no bytes, its scans do not: where the counts differ, one is looked up.
    without_bytes = len(_listed(spark, roots)._jdf.inputFiles()) != sum(r.files for r in rows)
    bare, differs, empty = (sorted(r[c] for r in rows if r[c] is not None) for c in ("bare", "differs", "empty"))
    bare += [f for f in [_file_without_bytes(spark, roots) if without_bytes else None] if f]
    if bare:
        example = f"CSV file without a header: {bare[0]}"
    elif differs:
        found = [name.strip().strip('"') for name in differs[0].header.split(",")]
        odd = sorted(set(schema.names) ^ set(found)) or sorted({n for n in found if found.count(n) > 1})
        example = f"Header of {differs[0].file} differs in {odd}"
    elif empty and need_rows:
        example = f"No rows in CSV file {empty[0]}"
    folders = {r.folder for r in rows} | {f.rsplit("/", 1)[0] for f in bare}
    return IndexFaults(folders, sum(r.reordered for r in rows), example)


def _read(
    spark: SparkSession,
    roots: Sequence[str],
    schema: T.StructType,
    strict: bool,
    start: dt.datetime | str | None = None,
    end: dt.datetime | str | None = None,
    mark_bad: bool = False,
    reordered: DataFrame | None = None,
) -> DataFrame:
    """Typed rows with ``file`` and ``pos``, and with ``_bad``, the line of a row that cannot be read, if asked for.

    ``reordered`` is the file index if any file has its columns in another order.
    """
    reader = spark.read.option("pathGlobFilter", "*.csv").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    literal = [_literal(r) for r in roots]
    if reordered is None:
        layout = T.StructType([*schema, T.StructField(_BAD, T.StringType())]) if mark_bad else schema
        reader = reader.schema(layout).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", _BAD)
        # A split is read in order by one task, so split start and row number give the file order.
        scan = _bounded(reader.csv(literal), start, end, mark_bad)
        scan = scan.select(*layout.names, _file_path().alias("file"), _position().alias("pos"))
    else:
        scan = _bounded(_by_place(reader, literal, schema, strict, reordered), start, end, mark_bad)
    if strict:
        # Naming every column keeps them all in the scan, so every value is parsed and checked. The
        # text of the error is put together only for a row that lacks something.
        anything = F.lit(False)
        for c in schema.names:
            anything = anything | F.col(c).isNull()
        empty = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in schema.names])
        message = F.concat(F.lit("Value missing: "), empty, F.lit(" in "), "file")
        scan = scan.where(F.when(anything, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return scan.withColumn("timestamp", epoch_to_timestamp(F.col("timestamp")))


def _bounded(scan: DataFrame, start, end, keep_unknown: bool) -> DataFrame:
    """Rows within the bounds of the raw column, which reach the scan; with ``keep_unknown`` also those without a time."""
    time = F.col("timestamp")
    for bound in (
        None if start is None else time >= -(-epoch_micros(start) // 1_000_000),
        None if end is None else time <= epoch_micros(end) // 1_000_000,
    ):
        if bound is not None:
            scan = scan.where(bound | time.isNull() if keep_unknown else bound)
    return scan


def _position() -> Column:
    return F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))


def _by_place(reader, roots: list[str], schema: T.StructType, strict: bool, index: DataFrame) -> DataFrame:
    """Rows of files with columns in any order: cells by place, which the file's header in the index gives names."""
    cells = [f"_c{i}" for i in range(len(schema))]
    layout = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, _BAD]])
    raw = reader.schema(layout).option("header", False).option("columnNameOfCorruptRecord", _BAD).csv(roots)
    raw = raw.select(F.array(*cells).alias("_cells"), _BAD, _file_path().alias("file"), _position().alias("pos"))
    # The header is the first row of the first split. It goes before the join, where nothing has looked at its values.
    header = (F.col("pos.split") == 0) & F.array_contains("_cells", schema.names[0]) & F.array_contains("_cells", schema.names[-1])
    raw = raw.where(~F.coalesce(header, F.lit(False)))
    places = F.transform(F.array(*map(F.lit, schema.names)), lambda c: F.array_position(_names(F.col("header")), c).cast("int"))
    rows = raw.join(index.select("file", places.alias("_places")), "file")
    texts = F.transform("_places", lambda at: F.element_at("_cells", at))
    kinds = {f.dataType.simpleString(): f.dataType for f in schema}
    # Through a generator, so that what follows does not repeat the computation for each column.
    made = F.struct(
        texts.alias("_texts"), *[F.transform(texts, _as(k)).alias(f"_{name}") for name, k in kinds.items()]
    )
    rows = rows.select("file", "pos", _BAD, F.inline(F.array(made)))
    values = [F.col(f"_{f.dataType.simpleString()}")[i] for i, f in enumerate(schema)]
    lost = F.exists(
        F.zip_with("_texts", F.array(*[v.isNull() for v in values]), lambda t, none: t.isNotNull() & none), lambda x: x
    )
    # The line in the order of the schema, as ``_unread`` takes it.
    line = F.array_join("_texts", ",", "")
    bad = F.coalesce(_BAD, F.when(lost, line))
    done = F.struct(*[v.alias(f.name) for v, f in zip(values, schema, strict=True)], bad.alias(_BAD))
    rows = rows.select("file", "pos", F.inline(F.array(done))).select(*schema.names, _BAD, "file", "pos")
    if strict:
        message = F.concat(F.lit("Value of wrong type: FAILED_READ_FILE "), "file")
        rows = rows.where(F.when(F.col(_BAD).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return rows


def _as(kind: T.DataType) -> Callable[[Column], Column]:
    return lambda text: text.try_cast(kind)


def _without_host(path: Column) -> Column:
    """A path without scheme and host; no regular expression, as it runs per row."""
    return F.substr(path, F.call_function("locate", F.lit("/"), path, F.locate("://", path) + 3))


def _file_path() -> Column:
    """Path of the row's file without scheme and host."""
    uri = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return _without_host(F.when(uri.contains("%"), decoded).otherwise(uri))


def _folder_of(file: Column) -> Column:
    name = F.substring_index(file, "/", -1)
    return F.coalesce(F.nullif(F.left(file, F.length(file) - F.length(name) - 1), F.lit("")), F.lit("/"))


def _opens(path: str) -> bool:
    """Whether the tasks can open the path themselves: a local one, or one of a store Arrow knows by this name."""
    scheme = re.match("^([a-zA-Z][a-zA-Z0-9+.-]*):", str(path))
    return scheme is None or scheme[1].lower() in ("file", "s3", "gs")


def _beginnings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the first line of each file, and whether another line holds anything; reads no further than that."""
    from pyarrow import fs

    def beginning(path: str) -> tuple[str | None, bool]:
        if "://" in path and not path.startswith("file:"):
            scheme = re.match(_SCHEME, path)[0]
            system, inner = fs.FileSystem.from_uri(scheme + quote(path[len(scheme) :]))
        else:
            system, inner = fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
        with system.open_input_stream(inner) as stream:
            data, rest = b"", b""
            while not rest.strip() and (more := stream.read(4096)):
                data = data + more if b"\n" not in data else data[: data.index(b"\n") + 1] + more
                rest = data[data.index(b"\n") + 1 :] if b"\n" in data else b""
        line = data.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")
        return line or None, bool(rest.strip())

    for batch in batches:
        found = [beginning(p) for p in batch["path"]]
        yield batch.assign(header=[h for h, _ in found], has_rows=[r for _, r in found])


def _plain(path: str) -> str:
    """A path without scheme and host, as it appears in ``file``."""
    path = str(path)
    if re.match(_SCHEME, path):
        path = unquote(re.sub(_SCHEME, "", path))
    return path.rstrip("/") or "/"


def _literal(path: str) -> str:
    """Escape characters that a file pattern would interpret."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", str(path))
