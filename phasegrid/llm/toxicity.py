"""Toxic spans and document scores from a linear-chain conditional random field.

Labels belong to documents; token labels follow from them. A word is known by its beginnings of four to
eight characters and, if it is no longer, by itself: its stems. Over all labelled training documents
Spark counts how often, and in how many documents, each stem occurs in the toxic and in the other ones.
Stems that are much more frequent in toxic documents and occur in a fair share of them mark the toxic
tokens of toxic documents; all other tokens are clean. A two-state field is fitted to a bounded sample so
labelled, by its exact gradient from forward-backward. Marginals of a text's tokens give the
offending spans, and their noisy-or and sum its score, calibrated on the sample and moved to the
share of toxic documents in the whole training set. Forward-backward runs over a run of texts as one stream, cut into chunks whose
transfer matrices are multiplied first, so that texts of any length cost the same per token.

Cases: a null or empty text has no tokens and gets the score of a text without toxic tokens; without
toxic, or without clean, training documents all scores are the share of toxic ones; labels of null count
as none, several labels of a document as one row each; equal texts get equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.scratch import written
from phasegrid.llm.texts import ALPHANUMERIC_LOWER, TEXT, Words, map_texts, pieces

#: Bounds of the sample the field is fitted to: documents of each class, and their size.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 300, 20_000
#: Stems the field knows by their counts; the rest are alike to it.
VOCABULARY = 20_000
#: A stem marks toxic tokens from this log ratio on, if so large a share of toxic documents has it.
MARK_RATIO, MARK_SHARE = 2.5, 0.03
STEM_SIZES = range(4, 9)
ROUNDS = 40
THRESHOLD = 0.7
SPAN_MARGINAL = 0.5


@dataclass
class Field:
    """Weights: of a word's log ratio here, before and after; of single stems; of steps between states."""

    stems: dict[str, int]
    ratios: np.ndarray
    emission: np.ndarray
    own: np.ndarray
    steps: np.ndarray
    start: float
    scale: np.ndarray
    shift: float = 0.0

    def known(self, words: list[bytes]) -> np.ndarray:
        """The number of each word's most telling stem, or -1."""
        at = np.full(len(words), -1, np.int64)
        for i, word in enumerate(words):
            found = [n for n in map(self.stems.get, stems(word.decode(errors="replace"))) if n is not None]
            if found:
                at[i] = max(found, key=self.ratios.__getitem__)
        return at


def stems(word: str) -> list[str]:
    """Beginnings of a word, and the word with a mark of its end."""
    made = [word[:n] for n in STEM_SIZES if n <= len(word)]
    return [*made, word + "."] if len(word) < STEM_SIZES.stop else made


def stem_counts(labelled: DataFrame) -> DataFrame:
    """stem, toxic, clean, toxic_docs: occurrences by class in the labelled documents (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column(1).cast(pa.large_binary()), ALPHANUMERIC_LOWER)
                toxic = np.array(piece.column(0).to_pylist(), np.int64)[words.owners()]
                numbers: dict[str, int] = {}
                distinct = words.values.cast(pa.large_binary()).to_pylist()
                lists = [[numbers.setdefault(s, len(numbers)) for s in stems(w.decode(errors="replace"))] for w in distinct]
                sizes = np.array([len(x) for x in lists], np.int64)
                flat, firsts = np.array([n for x in lists for n in x], np.int64), np.cumsum(sizes) - sizes
                size = len(numbers)
                # Occurrences are counted by distinct word first, then shared out to its stems.
                hits = np.bincount(words.ids, toxic, len(sizes)).astype(np.int64)
                all_ = np.bincount(words.ids, minlength=len(sizes))
                by_stem = [np.bincount(flat, np.repeat(x, sizes), size).astype(np.int64) for x in (hits, all_ - hits)]
                ids, owners = words.ids[toxic == 1], words.owners()[toxic == 1]
                at = np.repeat(firsts[ids] - np.cumsum(sizes[ids]) + sizes[ids], sizes[ids]) + np.arange(sizes[ids].sum())
                in_docs = np.unique(np.repeat(owners, sizes[ids]) * max(size, 1) + flat[at]) % max(size, 1) if size else at
                columns = [pa.array(list(numbers), pa.string()), *map(pa.array, by_stem), pa.array(np.bincount(in_docs, minlength=size))]
                yield pa.RecordBatch.from_arrays(columns, names=["stem", "toxic", "clean", "toxic_docs"])

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias(TEXT)
    partial = labelled.select("toxic", text).mapInArrow(run, "stem string, toxic long, clean long, toxic_docs long")
    return partial.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_docs")])


def fit(labelled: DataFrame) -> Field | float:
    """A field from labelled training documents (toxic 0/1, text), or the share of toxic ones if there is one class."""
    labelled = labelled.select(F.col("toxic").cast("int").alias("toxic"), "text")
    sizes = {row["toxic"]: row["count"] for row in labelled.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return 1.0 if toxic else 0.0
    counted = written(stem_counts(labelled).filter("toxic + clean > 1"), "stems")
    all_toxic, all_clean = counted.agg(F.sum("toxic"), F.sum("clean")).first()
    ratio = F.log((F.col("toxic") + 0.5) / ((all_toxic or 0) + 1)) - F.log((F.col("clean") + 0.5) / ((all_clean or 0) + 1))
    counted = counted.withColumn("ratio", ratio)
    weight = F.abs("ratio") * F.sqrt(F.col("toxic") + F.col("clean"))
    known = counted.orderBy(weight.desc(), "stem").limit(VOCABULARY).collect()
    numbers = {row["stem"]: i for i, row in enumerate(known)}
    ratios = np.clip(np.array([row["ratio"] for row in known] + [0.0]), -4.0, 6.0)
    least = max(2.0, MARK_SHARE * toxic)
    marks = np.array([row["ratio"] > MARK_RATIO and row["toxic_docs"] >= least for row in known] + [False])
    field = Field(numbers, ratios, np.array([-3.0, 0.5, 0.0, 0.0]), np.zeros(len(ratios)), np.array([[0.0, -2.0], [-1.0, 0.0]]), -2.0, np.zeros(3))
    filled = labelled.withColumn("text", F.coalesce("text", F.lit("")))
    chosen = [filled.filter(F.col("toxic") == t).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_DOCUMENTS) for t in (0, 1)]
    sample = [_windows(rows, field, marks).toArrow() for rows in chosen]
    texts = pa.concat_arrays([c.cast(pa.large_binary()) for part in sample for c in part.column("text").chunks] or [pa.array([], pa.large_binary())])
    labels = np.repeat([0, 1], [part.num_rows for part in sample])
    _train(field, Words(texts, ALPHANUMERIC_LOWER), labels, marks)
    field.shift = math.log(toxic / clean) - math.log(max(1, labels.sum()) / max(1, (1 - labels).sum()))
    _calibrate(field, texts, labels)
    return field


def _windows(rows: DataFrame, field: Field, marks: np.ndarray) -> DataFrame:
    """The texts of ``rows``; of one longer than ``SAMPLE_BYTES`` the run of its words, so long, with most marked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column(0).cast(pa.large_binary())
                yield pa.RecordBatch.from_arrays([pa.array([_window(texts[i : i + 1], field, marks) for i in range(len(texts))], pa.binary())], names=["text"])

    return rows.select(F.col("text").cast("binary").alias(TEXT)).mapInArrow(run, "text binary")


def _window(text: pa.Array, field: Field, marks: np.ndarray) -> bytes:
    raw = text[0].as_py()
    if len(raw) <= SAMPLE_BYTES:
        return raw
    words = Words(text, ALPHANUMERIC_LOWER)
    values = words.values.cast(pa.large_binary()).to_pylist()
    ends = np.cumsum(np.array([len(v) + 1 for v in values], np.int64)[words.ids])
    marked = np.concatenate([[0], np.cumsum(marks[field.known(values)][words.ids])])
    starts = np.arange(len(ends))
    stops = np.searchsorted(ends, np.where(starts > 0, ends[starts - 1], 0) + SAMPLE_BYTES, "right")
    first = int((marked[stops] - marked[starts]).argmax()) if len(ends) else 0
    return b" ".join(values[i] for i in words.ids[first : stops[first]].tolist()) if len(ends) else b""


class _Stream:
    """Emissions of a run of texts and what forward-backward makes of them."""

    def __init__(self, field: Field, words: Words):
        known = field.known(words.values.cast(pa.large_binary()).to_pylist())
        self.ids = known[words.ids] if len(words.ids) else words.ids
        self.ratio = field.ratios[self.ids]
        self.starts = words.starts
        self.first = np.zeros(len(self.ids), bool)
        self.last = np.zeros(len(self.ids), bool)
        filled = words.counts > 0
        self.first[words.starts[:-1][filled]] = True
        self.last[words.starts[1:][filled] - 1] = True
        before = np.where(self.first, 0.0, np.roll(self.ratio, 1))
        after = np.where(self.last, 0.0, np.roll(self.ratio, -1))
        self.features = np.column_stack([np.ones(len(self.ids)), self.ratio, before, after])

    def emissions(self, field: Field) -> np.ndarray:
        return self.features @ field.emission + field.own[self.ids]


def forward_backward(emission: np.ndarray, first: np.ndarray, last: np.ndarray, steps: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of state 1 from what comes up to each token, and from what comes after it."""
    n = len(emission)
    length = max(1, int(math.sqrt(n)))
    chunks = -(-n // length)
    room = chunks * length - n
    e = np.exp(np.clip(np.concatenate([emission, np.zeros(room)]), -30, 30)).reshape(chunks, length).T.copy()
    opens = np.concatenate([first, np.ones(room, bool)]).reshape(chunks, length).T
    a = np.exp(steps)
    begin = math.exp(start)
    # Matrices act on (state 0, state 1); one that opens a text forgets what was before.
    oo, to = np.where(opens, 1.0, a[0, 0]), np.where(opens, 1.0, a[1, 0])
    ot, tt = np.where(opens, begin, a[0, 1]) * e, np.where(opens, begin, a[1, 1]) * e
    p = [np.ones(chunks), np.zeros(chunks), np.zeros(chunks), np.ones(chunks)]
    for t in range(length):
        p = [oo[t] * p[0] + to[t] * p[2], oo[t] * p[1] + to[t] * p[3], ot[t] * p[0] + tt[t] * p[2], ot[t] * p[1] + tt[t] * p[3]]
        top = np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
        p = [x / top for x in p]
    whole = np.array(p).T.reshape(chunks, 2, 2)
    left, right = np.ones((chunks, 2)), np.ones((chunks, 2))
    for k in range(1, chunks):
        v = whole[k - 1] @ left[k - 1]
        left[k] = v / v.max()
    for k in range(chunks - 2, -1, -1):
        v = whole[k + 1].T @ right[k + 1]
        right[k] = v / v.max()
    up, down = np.empty((length, chunks)), np.empty((length, chunks))
    r = left[:, 1] / np.maximum(left[:, 0], 1e-300)
    for t in range(length):
        r = (ot[t] + r * tt[t]) / (oo[t] + r * to[t])
        up[t] = r
    b = right[:, 1] / np.maximum(right[:, 0], 1e-300)
    for t in range(length - 1, -1, -1):
        down[t] = b
        b = (to[t] + tt[t] * b) / (oo[t] + ot[t] * b)
    up, down = (np.log(np.clip(x.T.ravel()[:n], 1e-300, 1e300)) for x in (up, down))
    return up, np.where(last, 0.0, down)


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def marginals(field: Field, stream: _Stream) -> np.ndarray:
    if not len(stream.ids):
        return np.zeros(0)
    up, down = forward_backward(stream.emissions(field), stream.first, stream.last, field.steps, field.start)
    # The sample holds as many toxic documents as others; the shift leads back to their true share.
    return _probability(up + down + field.shift)


def _train(field: Field, words: Words, labels: np.ndarray, marks: np.ndarray) -> None:
    """Adam steps on the likelihood of the token labels; small weights are preferred."""
    stream = _Stream(field, words)
    n = len(stream.ids)
    if not n:
        return
    truth = (marks[stream.ids] & (labels[words.owners()] == 1)).astype(np.float64)
    inner = np.flatnonzero(~stream.first)
    firsts = np.flatnonzero(stream.first)
    seen = np.array([[((1 - truth[inner - 1]) * (1 - truth[inner])).sum(), ((1 - truth[inner - 1]) * truth[inner]).sum()],
                     [(truth[inner - 1] * (1 - truth[inner])).sum(), (truth[inner - 1] * truth[inner]).sum()]])
    moments: dict[str, list[np.ndarray]] = {}
    for step in range(1, ROUNDS + 1):
        emission = stream.emissions(field)
        up, down = forward_backward(emission, stream.first, stream.last, field.steps, field.start)
        p = _probability(up + down)
        before, here = up[inner - 1], emission[inner] + down[inner]
        joint = np.stack([field.steps[0, 0] + 0 * here, field.steps[0, 1] + here, field.steps[1, 0] + before, field.steps[1, 1] + before + here])
        joint = np.exp(joint - joint.max(axis=0))
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        off = truth - p
        gradient = {
            "emission": stream.features.T @ off - 0.1 * field.emission,
            "own": np.bincount(np.where(stream.ids < 0, len(field.own) - 1, stream.ids), off, len(field.own)) - 0.5 * field.own,
            "steps": seen - expected - 0.1 * field.steps,
            "start": np.array(off[firsts].sum() - 0.1 * field.start),
        }
        for name, g in gradient.items():
            m, v = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
            m = moments[name][0] = 0.9 * m + 0.1 * g
            v = moments[name][1] = 0.99 * v + 0.01 * g * g
            change = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            setattr(field, name, getattr(field, name) + change if name != "start" else field.start + float(change))
        field.own[-1] = 0.0


def _evidence(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text 1, the noisy-or of the marginals as -log(1 - p), and the logarithm of 1 + their sum."""
    filled = np.flatnonzero(np.diff(starts) > 0)
    rows = np.zeros((len(starts) - 1, 3))
    rows[:, 0] = 1.0
    if len(filled):
        rows[filled, 1] = np.minimum(30.0, np.add.reduceat(-np.log1p(-np.minimum(p, 0.9999)), starts[filled]))
        rows[filled, 2] = np.log1p(np.add.reduceat(p, starts[filled]))
    return rows


def _calibrate(field: Field, texts: pa.Array, labels: np.ndarray) -> None:
    """Logistic regression of the label on the evidence by Newton steps, moved to the true share."""
    words = Words(texts, ALPHANUMERIC_LOWER)
    x = _evidence(marginals(field, _Stream(field, words)), words.starts)
    w = np.zeros(3)
    for _ in range(30):
        p = _probability(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-1])
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (labels - p) - np.array([1e-3, 1e-2, 1e-1]) * w), -2, 2)
    w[0] += field.shift
    field.scale = w


def score_texts(docs: DataFrame, field: Field | float, text: str = "text", threshold: float = THRESHOLD, drop_text: bool = False) -> DataFrame:
    """Each row with ``score``, ``predicted`` and ``toxic_spans``: the code points [start, end) of each offending
    run of words, and the largest marginal in it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def work(texts: pa.Array) -> dict:
        field = sent.value
        if isinstance(field, float):
            n = len(texts)
            return {"score": [field] * n, "predicted": [int(field >= threshold)] * n, "toxic_spans": [[] for _ in range(n)]}
        words = Words(texts, ALPHANUMERIC_LOWER)
        p = marginals(field, _Stream(field, words))
        score = _probability(_evidence(p, words.starts) @ field.scale)
        return {"score": score, "predicted": (score >= threshold).astype(np.int32), "toxic_spans": _spans(p, words)}

    return map_texts(docs, work, "score double, predicted int, toxic_spans array<struct<start:bigint,end:bigint,marginal:double>>", text, drop_text=drop_text)


def _spans(p: np.ndarray, words: Words) -> list[list[dict]]:
    """Runs of words that are rather toxic than not, as places in their text."""
    spans: list[list[dict]] = [[] for _ in range(len(words.starts) - 1)]
    hot = np.flatnonzero(p > SPAN_MARGINAL)
    owners = np.searchsorted(words.starts, hot, "right") - 1
    for owner in np.unique(owners).tolist():
        mine = hot[owners == owner]
        data = np.frombuffer(words.data, np.uint8, int(words.ends[owner + 1] - words.ends[owner]), int(words.ends[owner]))
        edges = np.diff(np.concatenate([[False], data != 32, [False]]).astype(np.int8))
        # A code point begins at each byte that does not continue another.
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        begins, ends = points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]
        runs = np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1)
        at = int(words.starts[owner])
        spans[owner] = [{"start": int(begins[r[0] - at]), "end": int(ends[r[-1] - at]), "marginal": float(p[r].max())} for r in runs]
    return spans


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """toxic, text of the labelled documents that may be learnt from, written once.

    The labels may be many, so they are merged with the documents at every size of the tables.
    """
    allowed = F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1
    rows = docs.filter(allowed).select(key, "text").join(labels.filter("toxic IS NOT NULL").select(key, "toxic").hint("merge"), key)
    return written(rows.select("toxic", "text"), "labelled")
