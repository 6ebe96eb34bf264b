"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. The 64 bits are
dealt into groups, bits that go together into the same group, and each group i gets a threshold t_i
with sum(t_i + 1) = distance + 1: two fingerprints within the distance then agree up to t_i bits
in at least one group. A dynamic program picks the thresholds, and the number of groups, that promise
the fewest candidates on a sample of fingerprints; the promise affects cost, never the result.

Fingerprints that share a group's bits (up to t_i of them) form a bucket. A bucket of at most
``PAIR_LIMIT`` fingerprints compares its pairs. A larger one is never paired: each member sends every
value within half the distance of it, and members that meet at a value are linked to the least of
them, provided that they are near enough themselves. For a distance of 1 or 2 all links are found so;
each member costs 65 rows at most, however large the bucket is.

Fingerprints, not texts, are linked: copies are one fingerprint. ``near_duplicates`` then joins the
links into components by hooking and pointer jumping over written tables.

Cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any other; a
text of fewer words than a shingle is one shingle; equal rows fall together; a component of null ids
alone has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.scratch import written
from phasegrid.llm.texts import SPACED_LOWER, buffer_of, map_texts, quoted, without

BITS, SEED = 64, 42
SHINGLE, DISTANCE = 3, 2
PAIR_LIMIT = 64
#: Fingerprints the grouping and the thresholds are chosen on.
SAMPLE = 4096
EDGES = "src long, dst long"


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", drop_text: bool = True) -> DataFrame:
    """Each row with ``fingerprint``, the 64 bits as a signed long; nothing is shuffled."""

    def work(texts: pa.Array) -> dict:
        return {"fingerprint": _fingerprints(texts, shingle)}

    return map_texts(docs, work, "fingerprint long", text, drop_text=drop_text)


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    data, ends = buffer_of(texts)
    folded = data.tobytes().translate(SPACED_LOWER)
    result = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        words = folded[a:b].split()
        if not words:
            continue
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stops = np.cumsum(sizes) - 1
        starts = stops + 1 - sizes
        line = b" ".join(words)
        n = max(1, len(words) - shingle + 1)
        left, right = starts[:n].tolist(), stops[min(shingle, len(words)) - 1 :].tolist()
        values = np.fromiter((digest(line[p:q], SEED) for p, q in zip(left, right, strict=True)), np.uint64, n)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 4096):
            # Columns are the bits from the highest to the lowest.
            bits = np.unpackbits(values[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        result[i] = int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")
    return result.view(np.int64)


def plan_groups(sample: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Groups of bit numbers with their thresholds, from a sample of fingerprints.

    For each number of groups, correlated bits are put together, the candidates of each group are
    estimated for each threshold, and a dynamic program shares out the thresholds.
    """
    bits = ((sample.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    alike = np.abs(centred.T @ centred) / max(1, len(sample))
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for n_groups in range(1, distance + 2):
        groups = _correlated(alike, n_groups)
        costs = [[_cost(bits[:, g], t) for t in range(-1, distance + 1)] for g in groups]
        cost, thresholds = share_thresholds(costs, distance)
        if best is None or cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    return best[1]


def _correlated(alike: np.ndarray, n_groups: int) -> list[list[int]]:
    """Fill one group after another with the bit that goes best with those already in it."""
    free, groups = set(range(BITS)), []
    for g in range(n_groups):
        size = -(-len(free) // (n_groups - g))
        group = [min(free, key=lambda b: (-alike[b, list(free)].sum(), b))]
        free.discard(group[0])
        while len(group) < size:
            nxt = min(free, key=lambda b: (-alike[b, group].sum(), b))
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def _cost(bits: np.ndarray, threshold: int) -> float:
    """Estimated candidates per fingerprint within ``threshold`` of it in these bits, and its probes."""
    if threshold < 0:
        return 0.0
    sample = bits[:512]
    apart = np.abs(sample[:, None, :] - sample[None, :, :]).sum(axis=2) if len(sample) else np.zeros((0, 0))
    met = float((apart <= threshold).mean()) if len(sample) else 0.0
    probes = sum(_choose(bits.shape[1], t) for t in range(threshold + 1))
    return met * len(sample) + probes / 8


def _choose(n: int, k: int) -> int:
    return 1 if k == 0 else _choose(n, k - 1) * (n - k + 1) // k


def share_thresholds(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds from -1 with sum(t + 1) = distance + 1 and least total cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for by_threshold in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance - spent + 1):
                total = cost + by_threshold[t + 1]
                if spent + t + 1 not in after or total < after[spent + t + 1][0]:
                    after[spent + t + 1] = total, [*chosen, t]
        best = after
    return best[distance + 1]


def near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def links(prints: DataFrame, distance: int = DISTANCE, pair_limit: int = PAIR_LIMIT, purpose: str = "links") -> DataFrame:
    """Links ``src > dst`` between distinct fingerprints that join all those within the distance.

    Every pair within the distance is linked, directly or over others that are within it.
    """
    if not 0 < distance <= 2:
        raise ValueError("The distance must be 1 or 2: larger buckets are split at values half-way between fingerprints")
    sample = prints.orderBy(F.xxhash64("fingerprint")).limit(SAMPLE).toArrow()["fingerprint"].to_numpy()
    entries = None
    for number, (group, threshold) in enumerate(plan_groups(sample.view(np.uint64) if len(sample) else np.zeros(0, np.uint64), distance)):
        mask = sum(1 << b for b in group)
        flips = [sum(1 << b for b in c) for t in range(threshold + 1) for c in itertools.combinations(group, t)]
        value = F.col("fingerprint").bitwiseAND(_long(mask))
        rows = prints.select(F.lit(number).alias("group"), F.explode(F.array(*map(_long, flips))).alias("flip"), value.alias("value"), "fingerprint")
        rows = rows.select("group", F.col("value").bitwiseXOR(F.col("flip")).alias("bucket"), "fingerprint", (F.col("flip") == 0).alias("own"))
        entries = rows if entries is None else entries.unionByName(rows)
    entries = written(entries, purpose)
    sizes = entries.groupBy("group", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    placed = entries.join(sizes, ["group", "bucket"])
    small = placed.filter(F.col("n") <= pair_limit).drop("n")
    # A probe meets the fingerprints that own the bucket; two probes need not meet.
    probes = small.select("group", "bucket", F.col("fingerprint").alias("src"))
    owners = small.filter("own").select("group", "bucket", F.col("fingerprint").alias("dst"))
    pairs = probes.join(owners, ["group", "bucket"]).filter(F.col("src") != F.col("dst")).filter(near("src", "dst", distance))
    pairs = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    large = placed.filter(F.col("n") > pair_limit).select("fingerprint").distinct()
    return pairs.unionByName(meeting(large, distance)).distinct()


def meeting(prints: DataFrame, distance: int) -> DataFrame:
    """Link the fingerprints that share a mark to the least that bears it.

    Marks are such that those who share one are within the distance, and that all within it share one:
    for 2 each value one bit away or none, for 1 each bit with the value that lacks it.
    """
    own = F.col("fingerprint")
    if distance == 2:
        marks = [F.struct(F.lit(0).alias("bit"), own.bitwiseXOR(_long(m)).alias("value")) for m in (0, *(1 << b for b in range(BITS)))]
    else:
        marks = [F.struct(F.lit(b).alias("bit"), own.bitwiseAND(_long((1 << BITS) - 1 - (1 << b))).alias("value")) for b in range(BITS)]
    around = prints.select("fingerprint", F.explode(F.array(*marks)).alias("mark"))
    least = around.groupBy("mark").agg(F.min("fingerprint").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = around.join(least, "mark").select(F.col("fingerprint").alias("src"), "dst")
    return met.filter(F.col("src") != F.col("dst")).filter(near("src", "dst", distance))


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, root`` for every node of the links; the root is the least node of its component.

    Rounds of: each root hooks onto the least root that a link leads it to, chains are shortened by
    jumping, links are moved to the roots, and links within a root go. Each round is written.
    """
    edges = written(edges.select("src", "dst"), purpose)
    labels = written(edges.selectExpr("src AS node").union(edges.selectExpr("dst AS node")).distinct().selectExpr("node", "node AS root"), purpose)
    while not edges.isEmpty():
        hooks = edges.groupBy("src").agg(F.min("dst").alias("parent"))
        parents = written(hooks.selectExpr("src AS node", "parent"), purpose)
        while True:
            above = parents.selectExpr("node AS parent", "parent AS grandparent")
            jumped = parents.join(above, "parent", "left").selectExpr(
                "node", "coalesce(grandparent, parent) AS parent", "grandparent IS NOT NULL AS moved"
            )
            jumped = written(jumped, purpose)
            parents = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        to = parents.selectExpr("node AS root", "parent")
        labels = written(labels.join(to, "root", "left").selectExpr("node", "coalesce(parent, root) AS root"), purpose)
        a, b = parents.selectExpr("node AS src", "parent AS a"), parents.selectExpr("node AS dst", "parent AS b")
        moved = edges.join(a, "src", "left").join(b, "dst", "left").selectExpr("coalesce(a, src) AS a", "coalesce(b, dst) AS b")
        moved = moved.filter("a <> b").selectExpr("greatest(a, b) AS src", "least(a, b) AS dst").distinct()
        edges = written(moved, purpose)
    return labels


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Each row, without its text, with ``fingerprint`` (16 hex digits) and ``component_id``, the least key it is linked with."""
    kept = [c for c in without(docs, ["fingerprint", "component_id"]) if c != text]
    rows = written(fingerprints(docs.select(*map(quoted, [*kept, text])), shingle, text), "fingerprints")
    classes = _classes(rows, key, distance, pair_limit)
    return rows.join(classes, "fingerprint").select(
        *map(quoted, kept), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with the least key."""
    rows = fingerprints(docs, shingle, text, drop_text=False).withColumn("__row", F.monotonically_increasing_id())
    rows = written(rows.withColumnRenamed("fingerprint", "__print"), "fingerprints")
    found = rows.select(F.col("__print").alias("fingerprint"), F.col(quoted(key)).alias("__key"), "__row")
    roots = _classes(found, "__key", distance, pair_limit).select("fingerprint", "root")
    first = F.min(F.struct(F.col("__key").isNull().alias("missing"), "__key", "__row"))["__row"]
    stay = found.join(roots, "fingerprint").groupBy("root").agg(first.alias("__row")).select("__row")
    return rows.join(stay, "__row", "left_semi").select(*map(quoted, docs.columns))


def _classes(found: DataFrame, key: str, distance: int, pair_limit: int) -> DataFrame:
    """fingerprint, root, component_id of every distinct fingerprint."""
    classes = written(found.groupBy("fingerprint").agg(F.min(quoted(key)).alias("least")), "classes")
    roots = components(links(classes.select("fingerprint"), distance, pair_limit))
    linked = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(linked.join(least, "root").select("fingerprint", "root", "component_id"), "ids")
