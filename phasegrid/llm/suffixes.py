"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``LENGTH`` bytes contains the place where the hash of the next ``GRAM`` bytes is least;
equal strings have it at the same distance from their start. Only the suffixes at these places, the
anchors, about one in 170 bytes, are indexed. A run is a suffix array of them: dealt out by range and
sorted, so that its files follow each other in order. Suffixes are compared block by block, by the hash of
their first ``GRAM`` bytes, then by that of ``LENGTH`` bytes, then by that of all bytes a string of
``LENGTH`` around the anchor can have: those with a common beginning stand next to each other, though
blocks are in the order of their hashes and not of their bytes.

A new batch is merged in order with the runs of all levels and scanned once, neighbour by neighbour: suffixes
that begin like a new one are told, with the older ones they stand beside. Runs of one level merge into one
of the next, so that a family of n batches has at most log2(n) + 1 runs; a scan that covers all that merge
is stored as the merged run.

Suffixes that begin alike are then compared with their surroundings. Anchors with equal surroundings settle
each other. Of those that remain, one of each kind is fetched, and its strings are compared with the
strings at the same distance in the others; a group of more than ``GROUP`` kinds is compared by an
aggregation over its strings instead of in one task.

Texts are known by two 64-bit hashes, so copies are one text; those that lie near each other in the
table are indexed once, with their number. Strings never span texts.

Cases: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; a text that occurs twice is
removed whole if it is long enough; runs of one byte repeat themselves and go; very long texts are indexed
piece by piece, with the same result; extra columns stay, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.llm.scratch import discard, written
from phasegrid.llm.texts import buffer_of, map_texts, quoted, without
from phasegrid.session import scratch_dir

LENGTH, GRAM = 400, 64
#: Kinds of surroundings that one task compares; larger groups are aggregated.
GROUP = 20_000
#: Kinds of one gram that are counted in one place; those of more common grams are dealt out further.
SPREAD = 1_000
BATCHES = 3
SEGMENT = 1 << 20
#: An indexed suffix; ``copies`` of its text, equal in all else, came from the piece of input ``src``.
_ENTRY = "t1 long, t2 long, pos long, gram long, ahead long, around long, before int, after int, copies int, src long"
_COLUMNS = [c.split()[0] for c in _ENTRY.split(", ")]
_ORDER = ["gram", "ahead", "around", "t1", "t2", "pos", "src"]
RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x * _MIX[k % 4]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the ``GRAM`` bytes from it on, built up by doubling; never 0."""
    x = _mixed(np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(np.uint64) + np.uint64(1), 0)
    step = 1
    while step < GRAM:
        x = _mixed(x[:-step] * _MIX[2] + x[step:], step)
        step *= 2
    return x[: len(data)] | np.uint64(1)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over x[i : i + width] for each i that has so many."""
    n = len(x) - width + 1
    room = np.full(-len(x) % width, x[-1], x.dtype)
    blocks = np.concatenate([x, room]).reshape(-1, width)
    onward = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], onward[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the anchors of all strings of ``length`` bytes within the texts that ``ends`` bound."""
    width = length - GRAM + 1
    if len(data) < length:
        return np.zeros(0, np.int64)
    hashes = gram_hashes(data)
    least = _sliding(hashes, width, np.minimum)
    # least[o] belongs to the string that starts at o; those that would leave their text do not count.
    count = len(data) - length + 1
    least = least[:count].copy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        least[max(a, b - length + 1) : b] = 0
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    highest = _sliding(around, width, np.maximum)
    return np.flatnonzero(highest == hashes[: len(highest)])


def text_anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a run of texts, with their gram hashes; long runs go piece by piece."""
    total, places = len(data), []
    for at in range(0, max(total, 1), SEGMENT):
        low, high = max(0, at - length), min(total, at + SEGMENT + length)
        inner = np.unique(np.clip(ends - low, 0, high - low))
        places.append(anchors(data[low:high], np.union1d(inner, [0, high - low]), length) + low)
    found = np.unique(np.concatenate(places))
    if not len(found):
        return found, found.astype(np.uint64), found
    grams = np.concatenate(
        [gram_hashes(data[at : at + SEGMENT + GRAM])[found[(found >= at) & (found < at + SEGMENT)] - at] for at in range(0, total, SEGMENT)]
    )
    return found, grams, np.searchsorted(ends, found, "right") - 1


def entries(docs: DataFrame, length: int = LENGTH, batch: int = 0) -> DataFrame:
    """A row for each anchor of each text of ``docs`` (t1, t2, content); copies within a piece are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (batch << 48) | (TaskContext.get().partitionId() << 28)
        for rows in batches:
            for start, stop in _cuts(rows.column(2)):
                yield _entries(rows.slice(start, stop - start), length, source)
                source += 1

    return docs.select("t1", "t2", F.col("content").cast("binary").alias("content")).mapInArrow(run, _ENTRY)


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(len(t.as_buffer()) if t.is_valid else 0 for t in texts):
        if i > start and size + n > SEGMENT:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def _entries(piece: pa.RecordBatch, length: int, source: int) -> pa.RecordBatch:
    times = Counter(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True))
    if len(times) < piece.num_rows:
        seen: dict[tuple, int] = {}
        for row, text in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True)):
            seen.setdefault(text, row)
        piece = piece.take(pa.array(list(seen.values())))
    copies = np.fromiter(times.values(), np.int32, len(times))
    data, ends = buffer_of(piece.column(2).cast(pa.large_binary()))
    found, grams, owner = text_anchors(data, ends, length)
    first, last = ends[owner] if len(owner) else found, ends[owner + 1] if len(owner) else found
    before, after = np.minimum(found - first, length - GRAM), np.minimum(last - found, length)
    whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    ahead, around = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
    for i, (at, low, high) in enumerate(zip(found.tolist(), (found - before).tolist(), (found + after).tolist(), strict=True)):
        ahead[i], around[i] = digest(whole[at:high]), digest(whole[low:high])
    take = pa.array(owner)
    columns = [piece.column(0).take(take), piece.column(1).take(take), pa.array(found - first)]
    columns += [pa.array(x.view(np.int64)) for x in (grams, ahead, around)]
    columns += [pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(copies[owner] if len(owner) else copies[:0])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(found), source))], names=_COLUMNS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan suffixes in order (``_COLUMNS``, fresh); ``met`` tells those beside others that begin alike, a new one among them.

    What begins or ends a batch may go on in the next one or in another task, so it counts as met: too
    many are harmless, as their surroundings are compared.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, copies, fresh = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("gram", "copies", "fresh"))
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        met = (np.add.reduceat(copies.astype(np.int64), starts) > 1) & np.logical_or.reduceat(fresh, starts)
        met[0] = met[-1] = True
        sizes = np.diff(np.append(starts, len(gram)))
        columns = [batch.column(n) for n in _COLUMNS]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.repeat(met, sizes))], names=[*_COLUMNS, "met"])


class SuffixFamily:
    """Runs of indexed suffixes in levels; a folder keeps them between batches.

    The newest manifest names the runs that count, so a batch that failed leaves the family as it was.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = LENGTH):
        self.spark, self.folder, self.length = spark, folder, length
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.levels, self.shared = 0, [], []
        if self.files.exists(path):
            self.number = max(int(s.getPath().getName()) for s in self.files.listStatus(path))
            state = json.loads(spark.read.text(f"{folder}/manifests/{self.number}", wholetext=True).first()[0])
            self.levels, self.shared = state["levels"], state["shared"]

    def _commit(self) -> None:
        self.number += 1
        out = self.files.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/{self.number}"), False)
        out.write(bytearray(json.dumps({"levels": self.levels, "shared": self.shared}).encode()))
        out.close()

    def _store(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _run(self, name: str, ddl: str = _ENTRY) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}")

    def _in_order(self, df: DataFrame) -> DataFrame:
        """A suffix array: ranges of suffixes, each sorted; what begins alike may fill several ranges."""
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartitionByRange(ranges, *_ORDER).sortWithinPartitions(*_ORDER)

    def _joined(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(*[f"{self.folder}/{name}" for name in names])

    def add(self, docs: DataFrame) -> None:
        """Index a batch (t1, t2, content), scan it merged with the runs of all levels, and merge equal levels."""
        new = self._store(entries(docs, self.length, self.number))
        older, (level, due) = [name for _, name in self.levels], (0, [])
        while self.levels and self.levels[-1][0] == level:
            due.append(self.levels.pop()[1])
            level += 1
        rows = self._run(new).withColumn("fresh", F.lit(True))
        if older:
            rows = rows.unionByName(self._joined(older).withColumn("fresh", F.lit(False)))
        scanned = self._in_order(rows).mapInArrow(_neighbours, f"{_ENTRY}, met boolean")
        if len(due) == len(older):
            run = self._store(scanned)
            met = self._run(run, f"{_ENTRY}, met boolean")
        else:
            run = self._store(self._in_order(self._joined([new, *due])))
            met = scanned
        self.shared.append(self._store(met.filter("met").drop("met")))
        self.levels.append([level, run])
        self._commit()
        for name in (new, *due):
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)

    def drop(self) -> None:
        """Remove the family and all it holds."""
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), True)

    def matches(self) -> DataFrame:
        """The indexed suffixes that begin like another, each once however many scans told of it."""
        if not self.shared:
            return self.spark.createDataFrame([], _ENTRY)
        found = self._joined(self.shared)
        return found.dropDuplicates(["src", "t1", "t2", "pos"]) if len(self.shared) > 1 else found


def repeated_spans(family: SuffixFamily, texts: DataFrame, group: int = GROUP) -> DataFrame:
    """t1, t2, start, stop of the maximal runs of repeated strings in the indexed texts; ``texts`` has t1, t2, content."""
    length, reach = family.length, family.length - GRAM
    kind = ["gram", "around", "before", "after"]
    matches = written(family.matches(), "matches")
    kinds = matches.groupBy(*kind).agg(F.sum("copies").alias("n"), F.min(F.struct("t1", "t2", "pos")).alias("one"))
    kinds = written(kinds, "kinds")
    # Equal surroundings: every string around the anchor is repeated.
    twice = kinds.filter("n > 1").select(*kind)
    settled = matches.join(twice, kind, "left_semi").selectExpr("t1", "t2", "pos - before AS start", "pos + after AS stop").distinct()
    open_kinds = with_kinds(kinds).selectExpr("gram", "kinds", "n", "before", "after", "one.t1 AS t1", "one.t2 AS t2", "one.pos AS pos")
    wanted = open_kinds.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "before", "after", "gram", "kinds", "n")).alias("places"))
    one_text = texts.groupBy("t1", "t2").agg(F.first(F.col("content").cast("binary")).alias("content"))
    fetched = one_text.join(wanted, ["t1", "t2"]).mapInArrow(_fetch(reach), "t1 long, t2 long, pos long, before int, after int, gram long, kinds long, n long, bytes binary")
    fetched = written(fetched, "surroundings")
    small = fetched.filter(F.col("kinds") <= group).repartition("gram").sortWithinPartitions("gram")
    compared = small.mapInArrow(_compare(length), "t1 long, t2 long, start long, stop long")
    spans = settled.unionByName(compared).unionByName(_aggregated(fetched.filter(F.col("kinds") > group), length))
    spans = written(maximal_runs(spans), "spans")
    discard(matches, kinds, fetched)
    return spans


def with_kinds(kinds: DataFrame, spread: int = SPREAD) -> DataFrame:
    """The rows whose gram has several, with their number as ``kinds``; a common gram's rows meet it in many places.

    The grams of more than ``spread`` rows are broadcast: at most one for every ``spread`` rows.
    """
    counts = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = counts.withColumn("parts", F.expr(f"int(ceil(kinds / {spread}))"))
    common = several.filter("parts > 1").select("gram", "parts")
    part = F.coalesce(F.pmod(F.xxhash64("around", "before", "after"), F.col("parts")), F.lit(0)).cast("int")
    dealt = kinds.join(F.broadcast(common), "gram", "left").withColumn("part", part).drop("parts")
    return dealt.join(several.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts"), ["gram", "part"]).drop("part")


def maximal_runs(spans: DataFrame) -> DataFrame:
    """The spans (t1, t2, start, stop) with those of a text that overlap or touch made one; sorted, so not held in memory."""
    text = Window.partitionBy("t1", "t2").orderBy("start", "stop")
    reached = F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("begins", F.when(F.col("start") <= reached, 0).otherwise(1))
    run = F.sum("begins").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = begun.withColumn("run", run).groupBy("t1", "t2", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.drop("run")


def _fetch(reach: int):
    """Cut the surroundings of the wanted anchors out of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                t1, t2, content, places = (batch.column(i)[row].as_py() for i in range(4))
                rows = [
                    (t1, t2, p["pos"], p["before"], p["after"], p["gram"], p["kinds"], p["n"], content[p["pos"] - p["before"] : p["pos"] + p["after"]])
                    for p in places
                ]
                types = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary()]
                names = ["t1", "t2", "pos", "before", "after", "gram", "kinds", "n", "bytes"]
                for at in range(0, len(rows), 4096):
                    columns = zip(*rows[at : at + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _window_codes(rows: np.ndarray, group: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each column c a number for the string rows[:, c : c + length], the group mixed in."""
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 1 << 63, rows.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    letters = rng.integers(1, 1 << 63, 256, np.uint64)
    code = group.astype(np.uint64) * _MIX[1]
    for c in range(length):
        code = code + letters[rows[:, c]] * weights[c]
    last = rows.shape[1] - length
    for c in range(last + 1):
        yield c, code
        if c < last:
            code = code + letters[rows[:, c + length]] * weights[c + length] - letters[rows[:, c]] * weights[c]


def _spread(batch: dict[str, list], length: int) -> np.ndarray:
    """Surroundings as rows of equal width, each anchor in the same column."""
    reach = length - GRAM
    rows = np.zeros((len(batch["bytes"]), reach + length), np.uint8)
    for i, (content, before) in enumerate(zip(batch["bytes"], batch["before"], strict=True)):
        rows[i, reach - before : reach - before + len(content)] = np.frombuffer(content, np.uint8)
    return rows


def _compare(length: int):
    """Compare the strings of each group at each distance from the anchor; groups come whole and in turn."""
    names = ["t1", "t2", "pos", "before", "after", "gram", "n", "bytes"]
    ready = 4096

    def solve(held: dict[str, list]) -> pa.RecordBatch:
        reach = length - GRAM
        rows, gram = _spread(held, length), np.array(held["gram"], np.int64)
        before, after = np.array(held["before"]), np.array(held["after"])
        first, last = np.full(len(rows), -1), np.full(len(rows), -1)
        for c, code in _window_codes(rows, gram, length):
            valid = np.flatnonzero((c >= reach - before) & (c + length <= reach + after))
            order = valid[np.argsort(code[valid], kind="stable")]
            same = code[order[1:]] == code[order[:-1]]
            hit = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) > 1 else order[:0]
            first[hit] = np.where(first[hit] < 0, c, first[hit])
            last[hit] = c
        found = np.flatnonzero((first >= 0) & (np.array(held["n"]) == 1))
        pos = np.array(held["pos"], np.int64)[found] - reach
        columns = [np.array(held[t], np.int64)[found] for t in ("t1", "t2")] + [pos + first[found], pos + last[found] + length]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t1", "t2", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in names}
        for batch in batches:
            rows = {n: batch.column(n).to_pylist() for n in names}
            for at in range(0, batch.num_rows, 512):
                part = {n: v[at : at + 512] for n, v in rows.items()}
                for n in names:
                    held[n] += part[n]
                if len(held["gram"]) >= ready and held["gram"][0] != held["gram"][-1]:
                    # The last group may go on in what follows.
                    cut = held["gram"].index(held["gram"][-1])
                    yield solve({n: v[:cut] for n, v in held.items()})
                    held = {n: v[cut:] for n, v in held.items()}
        if held["gram"]:
            yield solve(held)

    return run


def _aggregated(fetched: DataFrame, length: int) -> DataFrame:
    """The same for groups too large for a task: every string of every kind is a row to count."""
    reach = length - GRAM

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                held = {n: piece.column(n).to_pylist() for n in ("before", "after", "gram", "bytes")}
                before, after = np.array(held["before"]), np.array(held["after"])
                codes = dict(_window_codes(_spread(held, length), np.array(held["gram"], np.int64), length))
                for i in range(piece.num_rows):
                    c = np.arange(reach - before[i], reach + after[i] - length + 1)
                    made = [piece.column(n).slice(i, 1).take(pa.array(np.zeros(len(c), np.int64))) for n in ("t1", "t2", "pos", "gram", "n")]
                    code = np.array([codes[x][i] for x in c.tolist()], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*made, pa.array(c.astype(np.int32)), pa.array(code)], names=["t1", "t2", "pos", "gram", "n", "c", "code"])

    rows = fetched.mapInArrow(strings, "t1 long, t2 long, pos long, gram long, n long, c int, code long")
    rows = written(rows, "strings")
    twice = rows.groupBy("gram", "c", "code").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    hit = rows.filter("n = 1").join(twice, ["gram", "c", "code"]).groupBy("t1", "t2", "pos").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    return hit.selectExpr("t1", "t2", f"pos - {reach} + a AS start", f"pos - {reach} + b + {length} AS stop")


def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = BATCHES, group: int = GROUP, drop_text: bool = False
) -> DataFrame:
    """Each row with ``n_bytes, n_removed, n_spans, kept_sha256``, and ``kept_text`` unless the text is dropped.

    The table is indexed in ``batches`` parts; all strings are judged on the whole input.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(quoted(text)), F.lit(""))
    marks = [F.xxhash64(content).alias("t1"), F.xxhash64(F.lit(7), content).alias("t2")]
    texts = docs.select(*marks, content.alias("content")).filter(F.octet_length("content") >= length)
    family = SuffixFamily(spark, scratch_dir(spark, "suffixes"), length)
    for b in range(batches):
        family.add(texts.filter(F.pmod("t2", F.lit(batches)) == b))
    spans = repeated_spans(family, texts, group)
    family.drop()
    spans = spans.groupBy(F.col("t1").alias("__u1"), F.col("t2").alias("__u2")).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    result = [*RESULT, "kept_text"]
    kept = [c for c in without(docs, result) if not (drop_text and c == text)]
    rows = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).alias("__content"), *[m.alias(f"__t{i}") for i, m in enumerate(marks, 1)])
    joined = rows.join(spans, (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")), "left").select(
        *map(quoted, kept), "__content", "__spans"
    )

    def cut(contents: pa.Array, spans: pa.Array) -> dict:
        made: dict[str, list] = {n: [] for n in result}
        for whole, found in zip(contents.to_pylist(), spans.to_pylist(), strict=True):
            left, at, runs = [], 0, 0
            for s in sorted(found or [], key=lambda s: s["start"]):
                if s["start"] > at or not runs:
                    left.append(whole[at : s["start"]])
                    runs += 1
                at = max(at, s["stop"])
            left = b"".join([*left, whole[at:]])
            made["n_bytes"].append(len(whole))
            made["n_removed"].append(len(whole) - len(left))
            made["n_spans"].append(runs)
            made["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            made["kept_text"].append(None if drop_text else left.decode(errors="replace"))
        return made

    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    done = map_texts(joined, cut, ddl, "__content", drop_text=True, given=("__spans",))
    return done.drop("kept_text") if drop_text else done
