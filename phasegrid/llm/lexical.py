"""Ranked lexical search: a sharded index with block maxima, searched by Block-Max MaxScore.

Each task cuts its documents into shards of bounded bytes and inverts each shard: a row per term and shard
with the term's postings, in blocks of ``BLOCK`` documents. A block is stored as document gaps and term
frequencies, of two bytes where they fit, and can be decoded alone. Beside it stand its impacts: those pairs
(frequency, length of the document) that no other posting of the block beats in both. From them the largest
score a block can give follows exactly, whatever the statistics of the corpus turn out to be; so one pass over
the texts makes the index, and the counts N, L and df are sums over it.

A search joins the terms of the queries with the index and groups what is found by shard and block of
queries. In a shard each query splits its lists: while the global bounds (the best any shard has for a term)
of the weakest ones add up to less than the score it still needs, these are non-essential. A range of
documents is filled from the essential lists; for the documents found, the block maxima of the non-essential
lists are added to what they have, and a document that cannot reach the needed score is rejected before any
of its blocks is decoded. Heaps of the shards are merged by a window over query and rank.

To know early what a query needs, some of the shards (one in ``FIRST``) are searched first; the k-th score
found there is a lower bound for all others. No document is left out on any other ground.

Cases: a null text has no terms, and such a document is in no list; a query without terms has no results;
terms that a query repeats count as often; rows that repeat a document are documents of their own, and a
query that is repeated is answered as often; documents of equal score go by id, null ids last; an empty
table of documents or queries gives no rows; a text longer than a shard is a shard of its own. Results carry
their own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.scratch import discard, written
from phasegrid.llm.texts import ALPHANUMERIC_LOWER, TEXT, Words, bounded_batches, pieces, quoted

#: Postings of a block, and documents that a search fills at once.
BLOCK, RANGE = 128, 2048
#: One shard in so many is searched first.
FIRST = 8
#: Queries that search a shard together.
QUERIES = 512
#: Terms that a task hands on at once.
TERMS = 100_000
TOP = 10

_INDEX = (
    "shard long, term string, df int, best array<struct<tf:int,n:int>>, postings binary, "
    "ids array<long>, sizes binary, n_docs long, n_terms long"
)


def _pareto(owner: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The postings that no other of the same owner beats in both frequency and length, by owner."""
    order = np.lexsort((n, -tf, owner))
    # Lengths run down within an owner; each owner starts anew below all before it.
    level = n[order].astype(np.int64) - owner[order].astype(np.int64) * (1 << 32)
    least = np.minimum.accumulate(level)
    return order[np.concatenate([[True], least[1:] < least[:-1]])] if len(order) else order


def invert(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """Terms of a shard with df, list-level impacts and encoded postings, and the lengths of its documents."""
    words = Words(texts, ALPHANUMERIC_LOWER)
    sizes, docs = words.counts, len(texts)
    if not len(words.ids):
        kind = pa.list_(pa.struct([("tf", pa.int32()), ("n", pa.int32())]))
        return pa.array([], pa.string()), np.zeros(0, np.int64), pa.array([], kind), pa.array([], pa.large_binary()), sizes
    pairs, tf = np.unique(words.ids * docs + words.owners(), return_counts=True)
    term, doc = pairs // docs, pairs % docs
    df = np.bincount(term, minlength=len(words.values))
    starts = np.concatenate([[0], np.cumsum(df)])
    best = _pareto(term, tf, sizes[doc])
    fronts = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(term[best], np.arange(len(df) + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(tf[best].astype(np.int32)), pa.array(sizes[doc[best]].astype(np.int32))], ["tf", "n"]),
    )
    place = np.arange(len(term)) - starts[term]
    opens = place % BLOCK == 0
    block = np.cumsum(opens) - 1
    impacts = _pareto(block, tf, sizes[doc])
    impact_block, impact = block[impacts], np.column_stack([tf[impacts], sizes[doc[impacts]]])
    gaps = np.diff(doc, prepend=0)
    gaps[opens] = doc[opens]
    firsts = np.flatnonzero(opens)
    lasts = np.append(firsts[1:], len(term))
    block_starts = np.searchsorted(firsts, starts)
    impact_starts = np.searchsorted(impact_block, np.arange(len(firsts) + 1))
    fronts_a_block, blocks_a_term = np.diff(impact_starts), np.diff(block_starts)
    front_starts = impact_starts[block_starts]
    # All lists are laid out at once, in units of two bytes; a wide number takes two of them.
    wide_gap, wide_tf = 1 + int(docs > 1 << 16), 1 + int(int(tf.max()) >= 1 << 16)
    units = 4 + 6 * blocks_a_term + 4 * np.diff(front_starts) + (wide_gap + wide_tf) * df
    base = np.cumsum(units) - units
    out = np.zeros(int(units.sum()), "<u2")

    def put(at: np.ndarray, values: np.ndarray, wide: int = 2) -> None:
        out[at] = values & 0xFFFF
        if wide == 2:
            out[at + 1] = values >> 16

    put(base, blocks_a_term)
    put(base + 2, np.full(len(base), wide_gap + (wide_tf << 8)))
    of_block = term[firsts]
    head = base[of_block] + 4 + 6 * (np.arange(len(firsts)) - block_starts[of_block])
    for i, values in enumerate((doc[lasts - 1], lasts - firsts, fronts_a_block)):
        put(head + 2 * i, values)
    of_front = of_block[impact_block]
    at = base[of_front] + 4 + 6 * blocks_a_term[of_front] + 4 * (np.arange(len(impacts)) - front_starts[of_front])
    put(at, impact[:, 0])
    put(at + 2, impact[:, 1])
    within = np.arange(len(term)) - firsts[block]
    data = (base + 4 + 6 * blocks_a_term + 4 * np.diff(front_starts))[term] + (wide_gap + wide_tf) * (firsts[block] - starts[term])
    put(data + wide_gap * within, gaps, wide_gap)
    put(data + wide_gap * (lasts - firsts)[block] + wide_tf * within, tf, wide_tf)
    offsets = np.append(base, len(out)).astype(np.int64) * 2
    lists = pa.Array.from_buffers(pa.large_binary(), len(df), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return words.values.cast(pa.string()), df, fronts, lists, sizes


class Postings:
    """One term's list in one shard; blocks are decoded when asked for."""

    def __init__(self, data: bytes):
        n, code = (int(x) for x in np.frombuffer(data, "<u4", 2))
        self.data, self.wide_gap, self.wide_tf = data, 2 * (code & 0xFF), 2 * (code >> 8)
        head = np.frombuffer(data, "<u4", 3 * n, 8).reshape(n, 3).astype(np.int64)
        self.last, self.counts = head[:, 0], head[:, 1]
        ends = np.cumsum(head[:, 2])
        self.front_starts = ends - head[:, 2]
        self.front = np.frombuffer(data, "<u4", 2 * int(ends[-1]), 8 + 12 * n).reshape(-1, 2).astype(np.int64)
        sizes = self.counts * (self.wide_gap + self.wide_tf)
        self.at = 8 + 12 * n + 8 * int(ends[-1]) + np.cumsum(sizes) - sizes
        #: What a shard's search has made of the blocks: the largest shares, and documents with their shares.
        self.maxima: np.ndarray | None = None
        self.shared: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of the block ``i``."""
        count, at = int(self.counts[i]), int(self.at[i])
        gaps = np.frombuffer(self.data, f"<u{self.wide_gap}", count, at)
        tf = np.frombuffer(self.data, f"<u{self.wide_tf}", count, at + count * self.wide_gap)
        return np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)

    def between(self, low: int, high: int) -> range:
        """Blocks that may hold documents in [low, high)."""
        first = int(np.searchsorted(self.last, low))
        return range(first, min(len(self.last), int(np.searchsorted(self.last, high - 1)) + 1))


@dataclass(frozen=True)
class Index:
    """A written index: its postings, and the documents of its shards (``ids`` in the postings' order)."""

    table: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.table.where("term IS NOT NULL").select("shard", "term", "df", "best", "postings")

    @property
    def shards(self) -> DataFrame:
        return self.table.where("term IS NULL").select("shard", "ids", "sizes", "n_docs", "n_terms")

    def discard(self) -> None:
        discard(self.table)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    bounded_batches(docs.sparkSession)
    content = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    source = docs.select(F.col(quoted(key)).cast("long").alias("id"), content.alias(TEXT))
    kinds = pa.schema(
        [("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("best", pa.list_(pa.struct([("tf", pa.int32()), ("n", pa.int32())]))),
         ("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch):
                terms, df, fronts, lists, sizes = invert(piece.column(1).cast(pa.large_binary()))
                for at in range(0, len(terms), TERMS):
                    n = min(TERMS, len(terms) - at)
                    none = [pa.nulls(n, kinds.field(c).type) for c in ("ids", "sizes", "n_docs", "n_terms")]
                    own = [pa.array(df[at : at + n].astype(np.int32)), fronts.slice(at, n).cast(kinds.field("best").type)]
                    columns = [pa.array(np.full(n, shard)), terms.slice(at, n), *own, lists.slice(at, n).cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, *none], schema=kinds)
                own = {"shard": [shard], "ids": [piece.column(0).to_pylist()], "sizes": [sizes.astype("<i8").tobytes()], "n_docs": [int((sizes > 0).sum())], "n_terms": [int(sizes.sum())]}
                yield pa.RecordBatch.from_pydict({f.name: own.get(f.name, [None]) for f in kinds}, kinds)
                shard += 1

    return Index(written(source.mapInArrow(run, _INDEX), "index"))


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each posting's part of its term's weight, in whole numbers."""
    m = 25 + (75 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _share_above(impact: Column, n_docs: int, n_terms: int) -> Column:
    """No less than the part, for a bound: the quotient within is not rounded down, and the whole is raised by one."""
    m = F.lit(24) + F.lit(75.0 * n_docs / max(1, n_terms)) * impact["n"]
    return F.floor(F.lit(1e9) * impact["tf"] / (F.lit(1000) * impact["tf"] + F.lit(8) * m)) + 1


class _Query:
    """One query in one shard: its lists from the weakest to the strongest, and the best documents so far."""

    def __init__(self, lists: list[tuple[Postings, int, int]], needed: int, k: int):
        lists = sorted(lists, key=lambda x: x[2])
        self.lists = [p for p, _, _ in lists]
        self.weights = [w for _, w, _ in lists]
        self.reach = np.cumsum([bound for _, _, bound in lists])
        self.needed, self.k = needed, k
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def essential(self) -> int:
        """Lists below this place cannot bring a document to the needed score by themselves."""
        return int(np.searchsorted(self.reach, self.needed))

    def take(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """Keep what may be among the best k; documents of the k-th score all stay, as ids decide."""
        self.docs, self.scores = np.concatenate([self.docs, docs]), np.concatenate([self.scores, scores])
        if len(self.scores) >= self.k:
            kth = int(np.partition(self.scores, len(self.scores) - self.k)[len(self.scores) - self.k])
            self.needed = max(self.needed, kth)
            kept = self.scores >= self.needed
            self.docs, self.scores = self.docs[kept], self.scores[kept]


class Shard:
    """The lists of a shard that some queries need, and its documents."""

    def __init__(self, sizes: np.ndarray, n_docs: int, n_terms: int):
        self.sizes, self.n_docs, self.n_terms = sizes, n_docs, n_terms
        #: Blocks decoded and blocks whose documents were all rejected before.
        self.opened = self.spared = 0

    def block_maxima(self, p: Postings) -> np.ndarray:
        if p.maxima is None:
            share = shares(p.front[:, 0], p.front[:, 1], self.n_docs, self.n_terms)
            p.maxima = np.maximum.reduceat(share, p.front_starts)
        return p.maxima

    def scored(self, p: Postings, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in p.shared:
            self.opened += 1
            docs, tf = p.block(i)
            p.shared[i] = docs, shares(tf, self.sizes[docs], self.n_docs, self.n_terms)
        return p.shared[i]

    def search(self, q: _Query) -> None:
        for low in range(0, len(self.sizes), RANGE):
            high = min(low + RANGE, len(self.sizes))
            split = q.essential()
            if split >= len(q.lists):
                return
            self._fill(q, split, low, high)

    def _fill(self, q: _Query, split: int, low: int, high: int) -> None:
        score = np.zeros(high - low, np.int64)
        for p, w in zip(q.lists[split:], q.weights[split:], strict=True):
            for i in p.between(low, high):
                docs, share = self.scored(p, i)
                inside = slice(*np.searchsorted(docs, (low, high)))
                score[docs[inside] - low] += w * share[inside]
        # Documents in an essential list, that may still reach what the query needs.
        rest = int(q.reach[split - 1]) if split else 0
        docs = np.flatnonzero((score > 0) & (score + rest >= q.needed))
        for j in range(split - 1, -1, -1):
            if not len(docs):
                return
            p, w = q.lists[j], q.weights[j]
            rest = int(q.reach[j - 1]) if j else 0
            place = np.searchsorted(p.last, docs + low)
            maxima = np.append(w * self.block_maxima(p), 0)
            hopeful = score[docs] + maxima[place] + rest >= q.needed
            self.spared += len(np.unique(place)) - len(np.unique(place[hopeful]))
            docs, place = docs[hopeful], place[hopeful]
            for i in np.unique(place[place < len(p.last)]).tolist():
                mine = docs[place == i]
                found, share = self.scored(p, i)
                at = np.minimum(np.searchsorted(found, mine + low), len(found) - 1)
                there = found[at] == mine + low
                score[mine[there]] += w * share[at[there]]
        docs = docs[score[docs] >= max(1, q.needed)]
        if len(docs):
            q.take(docs + low, score[docs])


def _searching(n_docs: int, n_terms: int, k: int):
    """Search one shard for one block of queries; rows: one per term of the block, and the shard's documents."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(pc.is_null(table.column("term")))
        found = table.filter(pc.is_valid(table.column("term")))
        names = ["item", "id", "score"]
        if not own.num_rows or not found.num_rows:
            return pa.Table.from_pydict({n: pa.array([], pa.int64()) for n in names})
        ids = own.column("ids")[0].as_py()
        shard = Shard(np.frombuffer(own.column("sizes")[0].as_py(), "<i8"), n_docs, n_terms)
        asked: dict[int, list[tuple[Postings, int, int]]] = {}
        needs: dict[int, int] = {}
        for data, uses in zip(found.column("postings").to_pylist(), found.column("uses").to_pylist(), strict=True):
            p = Postings(data)
            for use in uses:
                asked.setdefault(use["item"], []).append((p, use["weight"], use["bound"]))
                needs[use["item"]] = use["needed"]
        out = {n: [] for n in names}
        for item, lists in asked.items():
            q = _Query(lists, needs[item], k)
            shard.search(q)
            best = sorted(zip((-q.scores).tolist(), [(ids[d] is None, ids[d]) for d in q.docs.tolist()], strict=True))[:k]
            out["item"] += [item] * len(best)
            out["id"] += [key for _, (_, key) in best]
            out["score"] += [-s for s, _ in best]
        return pa.Table.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """item, term, times: the terms of each query row; ``queries`` has the column ``item``."""
    source = queries.select("item", F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b"")).alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column(1).cast(pa.large_binary()), ALPHANUMERIC_LOWER)
                width = max(1, len(words.values))
                pairs, times = np.unique(words.owners() * width + words.ids, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(pairs // width)), words.values.cast(pa.string()).take(pa.array(pairs % width)), pa.array(times)],
                    names=["item", "term", "times"],
                )

    return source.mapInArrow(run, "item long, term string, times long")


def search(
    index: Index, queries: DataFrame, item: str = "item_id", text: str = "text", k: int = TOP
) -> DataFrame:
    """item, rank, doc_id, score: the ``k`` best documents of each query row, scores above 0 only."""
    postings, shards = index.postings, index.shards
    n_docs, n_terms = (v or 0 for v in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    own = written(queries.select(F.col(quoted(item)).alias("name"), F.col(quoted(text)).alias("text"), F.monotonically_increasing_id().alias("item")), "queries")
    terms = written(query_terms(own, "text"), "query-terms")
    wanted = postings.join(terms.select("term").distinct(), "term")
    share = F.array_max(F.transform("best", lambda b: _share_above(b, n_docs, n_terms)))
    stats = wanted.groupBy("term").agg(F.sum("df").alias("df"), F.max(share).alias("share"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighted = written(
        terms.join(stats, "term").select(
            "item", "term", (F.col("times") * weight).alias("weight"),
            (F.col("times") * weight * F.col("share")).alias("bound"),
        ),
        "weights",
    )
    # Row numbers of one task follow each other, so no block has more queries than this.
    block = F.floor(F.col("item") / QUERIES)

    def found(part: Column, needed: DataFrame | None) -> DataFrame:
        uses = weighted if needed is None else weighted.join(needed, "item", "left")
        least = F.lit(0).cast("long") if needed is None else F.coalesce("needed", F.lit(0)).cast("long")
        use = F.struct("item", "weight", "bound", least.alias("needed"))
        by_block = uses.groupBy(block.alias("block"), "term").agg(F.collect_list(use).alias("uses"))
        lists = postings.where(part).select("shard", "term", "postings").join(by_block, "term")
        kind = by_block.schema["uses"].dataType
        # The documents of a shard go to each block of queries.
        held = shards.where(part).select("shard", "ids", "sizes").join(lists.select("shard", "block").distinct(), "shard")
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        rows = lists.select("shard", "block", "term", "postings", "uses", none("ids", "array<long>"), none("sizes", "binary")).unionByName(
            held.select("shard", "block", none("term", "string"), none("postings", "binary"), F.lit(None).cast(kind).alias("uses"), "ids", "sizes")
        )
        return rows.groupBy("shard", "block").applyInArrow(_searching(n_docs, n_terms, k), "item long, id long, score long")

    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = written(ranked(found(early, None)), "first-results")
    needed = first.where(F.col("rank") == k).select("item", F.col("score").alias("needed"))
    results = ranked(found(~early, needed).unionByName(first.drop("rank")))
    done = written(results.join(own.select("item", "name"), "item").select(F.col("name").alias(item), "rank", F.col("id").alias("doc_id"), "score"), "results")
    discard(own, terms, weighted, first)
    return done
