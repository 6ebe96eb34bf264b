"""Hard negatives by shared candidate lists of anchor clusters.

Vectors become whole numbers, so scores are exact inner products. Anchors are clustered by angle (centres
from spherical k-means on a bounded sample); a cluster is cut into groups of about ``GROUP`` members, and
the candidates into shards of at most ``SHARD_BYTES``. A group goes through a shard as follows. No member
is further from the group's centre than the angle ``b``, so with a candidate at the angle ``t`` from the
centre and of length ``l``, a member of length ``q`` scores at most ``q * l * cos(max(0, t - b))``. The
shard is sorted once by this bound (without ``q``), and all members walk the sorted list in blocks. A member
stops as soon as the bound of the next block, with some room for rounding, is below the score it still
needs: that of its k-th candidate, which includes those of the shards its task walked before, or the least
score its window allows. Scores in a block come from one matrix product of the members still walking.

The same walk answers two questions: the best k candidates of an anchor's own label (its positives), and for
each positive the best k candidates of other labels whose score lies in a window below the positive's. Groups
meet shards in an equi-join on the shard, groups being the smaller side; both are packed rows of bounded
size. A task merges what its shards yield for a group before it emits, so what is shuffled at the end is k
rows a question, group and task.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors of
unequal length are padded with zeros; empty vectors score 0; rows that repeat an id are rows of their own (an
anchor that is repeated is mined as often, and its twin is another row); equal scores go by id. Components
beyond 64 bits saturate; scores that float arithmetic could round are computed with Python's integers, and
one beyond 64 bits fails. Columns other than those named are left out, so none can clash. An empty table, or
one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.scratch import discard, written
from phasegrid.llm.texts import bounded_batches

#: Sample of anchors that the centres are fitted to, the most centres, and the steps of the fit.
SAMPLE, CENTRES, ROUNDS = 4096, 64, 8
#: Members of a group, and most bytes of the vectors of a shard.
GROUP, SHARD_BYTES = 256, 2 << 20
#: Candidates that the members score at once.
BLOCK = 1024
#: Room for rounding in the bound, relative to the product of the lengths.
ROOM = 1e-6
#: Results a task holds before it hands them on.
HELD = 1 << 20
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies within these hundredths of the positive's.
LEAST, MOST = 30, 90
SCALE = 256

_PACKED = "rows binary, ids binary, labels binary, vectors binary, kind string"
_FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, found_id long, score long"
_NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row, id, label and the vector in whole numbers of all rows that take part."""
    kept = rows.select(
        F.col(key).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(vector, lambda v: v.cast("double")).alias("vector"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform("vector", lambda v: F.floor(v * SCALE).cast("long"))
    return kept.where(finite).select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("vector"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to ``dim``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    made = np.zeros((len(sizes), dim), np.int64)
    made[np.arange(dim) < sizes[:, None]] = values
    return made


def _packed(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    """The columns of one packed row; vectors take the fewest bytes that hold them."""
    low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    made = {"rows": rows, "ids": ids, "labels": labels, "vectors": vectors.astype(kind)}
    return {**{k: [v.tobytes()] for k, v in made.items()}, "kind": [kind]}


def _shards(dim: int) -> Callable:
    """Pack the rows of a task, in the order they come, into shards."""
    most = max(1, SHARD_BYTES // (2 * max(1, dim)))
    schema = pa.schema([("number", pa.int64()), *[(c, pa.binary()) for c in ("rows", "ids", "labels", "vectors")], ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, made = [], 0, 0
        part = TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.RecordBatch.from_pydict({"number": [(part << 32) + made], **_packed(*columns)}, schema)

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                held.append((*[piece.column(i).to_numpy() for i in range(3)], _matrix(piece.column(3), dim)))
                count += piece.num_rows
                if count >= most:
                    yield shard()
                    held, count, made = [], 0, made + 1
        if held:
            yield shard()

    return run


def _centres(sample: np.ndarray) -> np.ndarray:
    """Unit vectors to group anchors around: spherical k-means that starts at evenly spaced rows."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    k = max(1, min(CENTRES, len(unit) // (GROUP // 4)))
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1e-300), centres)
    return centres


def anchor_groups(anchors: DataFrame, dim: int) -> DataFrame:
    """``anchors`` with ``cluster`` and ``part``: alike anchors share a cluster, a large one is dealt out to parts."""
    spark = anchors.sparkSession
    sample = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").toArrow()
    points = _matrix(sample.column(0), dim) if sample.num_rows else np.zeros((1, dim))
    sent = spark.sparkContext.broadcast(_centres(points.astype(np.float64)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_matrix(batch.column(3), dim).astype(np.float64) @ sent.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    schema = "row long, id long, label long, vector array<bigint>, cluster int"
    near = written(anchors.select("row", "id", "label", "vector").mapInArrow(assign, schema), "anchors")
    sizes = near.groupBy("cluster").count().select("cluster", F.ceil(F.col("count") / GROUP).alias("parts"))
    # As many rows as there are centres at most, so this side may be sent to all.
    return near.join(F.broadcast(sizes), "cluster").select(
        "row", "id", "label", "vector", "cluster", F.pmod(F.xxhash64("row"), "parts").alias("part")
    )


def _pack_groups(grouped: DataFrame, dim: int) -> DataFrame:
    """One packed row per cluster and part, with the score windows of its members."""
    schema = pa.schema([*[(f"g_{c}", pa.binary()) for c in ("rows", "ids", "labels", "vectors")], ("g_kind", pa.string()), ("g_asked", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        columns = [table.column(c).to_numpy() for c in ("row", "id", "label")]
        asked = _matrix(table.column("asked"), len(table.column("asked")[0]))
        made = _packed(*columns, _matrix(table.column("vector"), dim))
        return pa.Table.from_pydict({**{f"g_{k}": v for k, v in made.items()}, "g_asked": [asked.tobytes()]}, schema)

    packed = "g_rows binary, g_ids binary, g_labels binary, g_vectors binary, g_kind string, g_asked binary"
    return grouped.groupBy("cluster", "part").applyInArrow(pack, packed)


class _Group:
    """The members of a group, what they ask for, and the best they have found so far."""

    def __init__(self, row: dict, same: bool, k: int):
        self.same, self.k = same, k
        self.rows, self.ids, self.labels = (np.frombuffer(row[f"g_{c}"], np.int64) for c in ("rows", "ids", "labels"))
        n = len(self.rows)
        self.vectors = np.frombuffer(row["g_vectors"], row["g_kind"]).reshape(n, -1)
        #: For each member and question: least and largest score, id and score of the positive.
        self.asked = np.frombuffer(row["g_asked"], np.int64).reshape(n, -1, 4)
        self.size = n * self.asked.shape[1] * k
        self.open = self.asked[:, :, 0] <= self.asked[:, :, 1]
        self.scores = np.full((*self.open.shape, k), _NONE)
        self.found = np.zeros((*self.open.shape, k), np.int64)
        real = self.vectors.astype(np.float64)
        self.lengths = np.linalg.norm(real, axis=1)
        unit = real[self.lengths > 0] / self.lengths[self.lengths > 0, None]
        centre = unit.sum(axis=0) if len(unit) else np.zeros(real.shape[1])
        self.centre = centre / max(np.linalg.norm(centre), 1e-300)
        self.spread = float(np.arccos(np.clip((unit @ self.centre).min(), -1, 1))) if len(unit) else 0.0

    def needed(self) -> np.ndarray:
        """The least score that is still of use to each question; none below it is."""
        return np.where(self.open, np.maximum(self.scores[:, :, -1], self.asked[:, :, 0]), np.iinfo(np.int64).max)

    def take(self, member: np.ndarray, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Keep the best k of what is there and what comes, by score and then by id."""
        width = self.open.shape[1]
        touched, slot = np.unique(member * width + question, return_inverse=True)
        m, w = touched // width, touched % width
        held = self.scores[m, w]
        real = held != _NONE
        slots = np.concatenate([np.nonzero(real)[0], slot])
        scores, found = np.concatenate([held[real], score]), np.concatenate([self.found[m, w][real], ids])
        order = np.lexsort((found, -scores, slots))
        slots = slots[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = place < self.k
        order, slots, place = order[kept], slots[kept], place[kept]
        self.scores[m[slots], w[slots], place] = scores[order]
        self.found[m[slots], w[slots], place] = found[order]

    def results(self) -> pa.RecordBatch:
        m, w, place = np.nonzero(self.scores != _NONE)
        columns = [
            self.rows[m], self.ids[m], w.astype(np.int32), self.asked[m, w, 2], self.asked[m, w, 3], self.found[m, w, place], self.scores[m, w, place],
        ]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=[c.split()[0] for c in _FOUND.split(", ")])


def _exact(group: _Group, vectors: np.ndarray) -> type:
    """A number type in which all inner products come out exactly."""
    top = [int(np.abs(v.astype(np.float64)).max()) if v.size else 0 for v in (group.vectors, vectors)]
    reach = top[0] * top[1] * max(1, vectors.shape[1])
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object


def walk(group: _Group, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
    """Lead the members of a group through a shard; returns how many scores were computed."""
    real = vectors.astype(np.float64)
    lengths = np.linalg.norm(real, axis=1)
    angle = np.arccos(np.clip(real @ group.centre / np.maximum(lengths, 1e-300), -1, 1))
    bound = lengths * np.cos(np.maximum(0.0, angle - group.spread)) + ROOM * lengths
    order = np.argsort(-bound, kind="stable")
    bound, kind = bound[order], _exact(group, vectors)
    members, scored = group.vectors.astype(kind), 0
    for at in range(0, len(order), BLOCK):
        needed = group.needed()
        least = needed.min(axis=1)
        walking = np.flatnonzero(group.lengths * bound[at] + ROOM >= least.astype(np.float64))
        if not len(walking):
            break
        block = order[at : at + BLOCK]
        scores = members[walking] @ vectors[block].astype(kind).T
        scored += scores.size
        fits = (labels[block] == group.labels[walking, None]) == group.same
        fits &= scores >= least[walking, None]
        m, c = np.nonzero(fits)
        m, c, score = walking[m], block[c], scores[m, c].astype(np.int64)
        other = rows[c] != group.rows[m]
        m, c, score = m[other], c[other], score[other]
        hits = (score[:, None] >= needed[m]) & (score[:, None] <= group.asked[m, :, 1]) & group.open[m]
        hit, question = np.nonzero(hits)
        if len(hit):
            group.take(m[hit], question, score[hit], ids[c[hit]])
    return scored


def _search(shards: DataFrame, groups: DataFrame, number: int, same: bool, k: int) -> DataFrame:
    """The best k candidates of every question of every anchor."""
    lanes = groups.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(max(1, number) - 1))))
    dealt = shards.withColumn("lane", F.pmod(F.xxhash64("number"), F.lit(max(1, number))).cast("int"))
    # Few rows that cost much: their number, not their bytes, tells how many tasks there should be.
    pairs = lanes.repartition(max(1, number), "lane").join(dealt.repartition(max(1, number), "lane"), "lane")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[bytes, _Group] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                group = states.get(row["g_rows"])
                if group is None:
                    if sum(g.size for g in states.values()) > HELD:
                        for done in states.values():
                            yield done.results()
                        states = {}
                    group = states[row["g_rows"]] = _Group(row, same, k)
                rows, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
                walk(group, rows, ids, labels, np.frombuffer(row["vectors"], row["kind"]).reshape(len(rows), -1))
        for done in states.values():
            yield done.results()

    found = pairs.drop("lane", "number").mapInArrow(run, _FOUND)
    best = Window.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    label: Column,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for all anchors.

    ``is_anchor`` is a condition on ``id``. An anchor's positives are its best ``positives`` other rows of
    its label; for each, the best ``negatives`` rows of other labels are found whose score lies from
    ``LEAST`` to ``MOST`` hundredths of the positive's.
    """
    bounded_batches(rows.sparkSession)
    vectors = written(whole_vectors(rows, label, key, vector), "vectors")
    dim = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    shards = written(vectors.mapInArrow(_shards(dim), f"number long, {_PACKED}"), "shards")
    number = shards.count()
    grouped = written(anchor_groups(vectors.where(is_anchor), dim), "groups")
    anything = F.array(*[F.lit(v).cast("long") for v in (-(1 << 62), 1 << 62, 0, 0)])
    first = _search(shards, _pack_groups(grouped.withColumn("asked", anything), dim), number, True, positives)
    best = written(first.select("anchor_row", "rank", F.col("found_id").alias("id"), "score"), "positives")
    # A member asks for one window a positive; where there are fewer positives, the rest are empty windows.
    p = F.col("score")
    window = [F.ceil(LEAST * p.cast("decimal(38,0)") / 100), F.floor(MOST * p.cast("decimal(38,0)") / 100), F.col("id"), p]
    windows = best.groupBy(F.col("anchor_row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.array(*[v.cast("long") for v in window]).alias("w")))).alias("ws")
    )
    empty = F.array_repeat(F.array(*[F.lit(v).cast("long") for v in (1, 0, 0, 0)]), positives)
    padded = F.slice(F.concat(F.transform("ws", lambda s: s["w"]), empty), 1, positives)
    asking = grouped.join(windows, "row").withColumn("asked", F.flatten(padded)).drop("ws")
    second = _search(shards, _pack_groups(asking, dim), number, False, negatives)
    mined = written(
        second.select(
            "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ),
        "negatives",
    )
    discard(vectors, shards, grouped, best)
    return mined
