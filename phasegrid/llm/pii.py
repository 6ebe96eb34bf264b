"""Personal data by fixed patterns and by a character-level BiLSTM with CRF transitions.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The network, written in
numpy, is trained on windows of a bounded sample of documents whose labelled spans the patterns give.
A third of these windows have the spans rewritten as people write them and the patterns do not see them
(``FORMS``: spaced or bracketed dots, numbers without ``+``, other separators), so that the network adds
such spans. It tags characters, knowing only their classes and what is around them. A text is cut into overlapping
windows, each is decoded by Viterbi search, spans that touch a cut are left to the next window, and
from all windows of the text the best set of spans that do not overlap is chosen. Such spans
are added where no pattern has one. Every kind holds a digit or an ``@``: a window without either
is outside by definition and is not run through the network.

Cases: a null or empty text has no spans; without any labelled window there is no network and only the
patterns count; positions are code points; spans of one kind never overlap; equal texts get equal spans;
of two sets of spans that are equally sure the one that ends first stays; texts of any length are decoded whole,
window by window; rows that repeat are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.scratch import written
from phasegrid.llm.texts import TEXT, map_texts, pieces

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 32
HIDDEN, EPOCHS, BATCH, RATE = 16, 8, 32, 0.02
#: Windows the network is trained on, at most: a third each without spans, with those of the patterns, with rewritten ones.
SAMPLE_WINDOWS = 1800
#: How sure the network must be of each character of a span, on average.
CONFIDENCE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind only keeps the search from trying every digit of a long run anew.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(rb"[0-9@]")
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if at >= free and start < at else None
        if match:
            yield start, match.end()
            free = match.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns, leftmost and without overlap for each kind; failing matches go."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


#: Ways to write each kind that no pattern matches: what is replaced, and by what.
FORMS = {
    "email": ((("@", " @ "),), (("@", " (@) "), (".", "(.)")), (("@", "[@]"), (".", " dot ")), ((".", " . "),)),
    "ip": (((".", " . "),), ((".", ","),), ((".", "[.]"),), ((".", "-"),)),
    "phone": ((("+", ""),), (("+", "00"),), (("+", ""), (" ", "/")), (("+", ""), ("(", ""), (")", ""), ("-", " "))),
}
#: What parts a card's digits, in fours.
PARTING = (".", "/", "_", "  ")


def rewritten(kind: str, found: str, form: int) -> str:
    """A span in another of its forms."""
    if kind == "card":
        digits = _digits(found)
        return PARTING[form % len(PARTING)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    for old, new in FORMS[kind][form % len(FORMS[kind])]:
        found = found.replace(old, new)
    return found


def varied(text: str, spans: list[tuple[str, int, int]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans rewritten, the form told by the span's content; and where they are then, if no pattern sees them."""
    parts, made, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < at:
            continue
        new = rewritten(kind, text[a:b], crc32(text[a:b].encode()))
        parts += [text[at:a], new]
        size += a - at
        made.append((kind, size, size + len(new)))
        size, at = size + len(new), b
    whole = "".join([*parts, text[at:]])
    seen = base_spans(whole)
    return whole, [s for s in made if not any(a < s[2] and s[1] < b for _, a, b in seen)] + seen


#: Classes of characters: these one by one, then other digits, letters by case, white space, the rest.
_SINGLE = "@._%+-()/:;,=#\"'<>[]{}|0123456789"
CLASSES = len(_SINGLE) + 7
TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    """The class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(128, len(_SINGLE), np.int64)
    for c in range(128):
        s = chr(c)
        table[c] = (
            _SINGLE.index(s) if s in _SINGLE else len(_SINGLE) + 1 if s.islower() else len(_SINGLE) + 2 if s.isupper()
            else len(_SINGLE) + 3 if s == "\n" else len(_SINGLE) + 4 if s.isspace() else len(_SINGLE)
        )
    return np.where(codes < 128, table[np.minimum(codes, 127)], len(_SINGLE) + 5)


_PAD = CLASSES - 1


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an ``@``."""
    starts = {s for m in re.finditer("[0-9@]", text) for s in range(max(0, (m.start() - WINDOW) // STRIDE + 1) * STRIDE, m.start() + 1, STRIDE)}
    return sorted(starts)


def _tags(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Tag of each character: 0 outside, 2k + 1 first and 2k + 2 further in a span of kind k."""
    tags = np.zeros(length, np.int64)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        tags[a:b] = 2 * k + 2
        tags[a] = 2 * k + 1
    return tags


@dataclass
class Network:
    """Weights by name: of both directions, of the output, of the transitions."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            w[f"h{d}"] = rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"] = rng.normal(0, 0.3, (2 * HIDDEN, TAGS))
        w["bias"] = np.zeros(TAGS)
        w["steps"] = np.zeros((TAGS, TAGS))
        return Network({k: v.astype(np.float32) for k, v in w.items()})


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, far below where not: only a span's own tags lead further into it."""
    rule = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 * k + 2
        rule[:, inside] = -1e4
        rule[[inside - 1, inside], inside] = 0
    return rule


ALLOWED = _allowed()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _direction(w: dict, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states of one direction over class numbers (batch, time); ``keep`` gets what the gradient needs."""
    batch, time = x.shape
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((batch, time, HIDDEN), np.float32)
    for t in range(time) if d == "f" else range(time - 1, -1, -1):
        z = w[f"x{d}"][x[:, t]] + h @ w[f"h{d}"] + w[f"c{d}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
    return out


def emissions(net: Network, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    both = []
    for d in "fb":
        steps = None if keep is None else keep.setdefault(d, [])
        both.append(_direction(net.weights, d, x, steps))
    states = np.concatenate(both, axis=2)
    if keep is not None:
        keep["states"] = states
    return states @ net.weights["out"] + net.weights["bias"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(e: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tags (batch, time, tag), expected steps between tags, log of all paths."""
    batch, time, tags = e.shape
    up, down = np.empty_like(e), np.zeros_like(e)
    first = np.zeros(tags, np.float32)
    first[2::2] = -1e4
    up[:, 0] = e[:, 0] + first
    for t in range(1, time):
        up[:, t] = _logsum(up[:, t - 1, :, None] + steps, 1) + e[:, t]
    for t in range(time - 2, -1, -1):
        down[:, t] = _logsum(steps + (e[:, t + 1] + down[:, t + 1])[:, None, :], 2)
    whole = _logsum(up[:, -1], 1)
    expected = np.zeros((tags, tags))
    for t in range(1, time):
        joint = up[:, t - 1, :, None] + steps + (e[:, t] + down[:, t])[:, None, :] - whole[:, None, None]
        expected += np.exp(joint).sum(axis=0)
    return np.exp(up + down - whole[:, None, None]), expected, whole


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch and its gradient by all weights."""
    w, keep = net.weights, {}
    e = emissions(net, x, keep)
    steps = w["steps"] + ALLOWED
    p, expected, whole = _crf(e, steps)
    batch, time = x.shape
    rows, cols = np.indices(x.shape)
    seen = np.zeros((TAGS, TAGS))
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    path = e[rows, cols, y].sum(axis=1) + steps[y[:, :-1], y[:, 1:]].sum(axis=1)
    off = p.copy()
    off[rows, cols, y] -= 1
    off /= batch
    made = {"steps": (expected - seen) / batch, "bias": off.sum(axis=(0, 1)), "out": np.einsum("bth,btk->hk", keep["states"], off)}
    back = off @ w["out"].T
    for n, d in enumerate("fb"):
        dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        gx, gh, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"]), np.zeros_like(w[f"c{d}"])
        for t, h, c, i, f, o, g in reversed(keep[d]):
            dh = dh + back[:, t, n * HIDDEN : (n + 1) * HIDDEN]
            now = np.tanh(f * c + i * g)
            dc = dc + dh * o * (1 - now * now)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * now * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(gx, x[:, t], dz)
            gh += h.T @ dz
            gc += dz.sum(axis=0)
            dh, dc = dz @ w[f"h{d}"].T, dc * f
        made |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
    return float((whole - path).mean()), made


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network fitted to windows of classes and tags by Adam steps."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            step += 1
            _, grads = gradients(net, x[order[at : at + BATCH]], y[order[at : at + BATCH]])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                rate = RATE / (1 + epoch / 4)
                net.weights[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def viterbi(e: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The best tags of each window."""
    batch, time, tags = e.shape
    first = np.zeros(tags, np.float32)
    first[2::2] = -1e4
    score, back = e[:, 0] + first, np.zeros((batch, time, tags), np.int8)
    for t in range(1, time):
        total = score[:, :, None] + steps
        back[:, t] = total.argmax(axis=1)
        score = total.max(axis=1) + e[:, t]
    path = np.empty((batch, time), np.int64)
    path[:, -1] = score.argmax(axis=1)
    for t in range(time - 1, 0, -1):
        path[:, t - 1] = back[np.arange(batch), t, path[:, t]]
    return path


def decode(net: Network, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """For each text the spans its windows agree on best, with their confidence."""
    places = [(i, s) for i, text in enumerate(texts) for s in windows(text)]
    coded = [classes(t) for t in texts]
    found: list[dict[tuple[str, int, int], float]] = [{} for _ in texts]
    steps = net.weights["steps"] + ALLOWED
    for at in range(0, len(places), 512):
        part = places[at : at + 512]
        x = np.full((len(part), WINDOW), _PAD, np.int64)
        for row, (i, s) in enumerate(part):
            cut = coded[i][s : s + WINDOW]
            x[row, : len(cut)] = cut
        # Equal windows, as copies have them, are decoded once.
        x, where = np.unique(x, axis=0, return_inverse=True)
        e = emissions(net, x)
        tags, p = viterbi(e, steps), _crf(e, steps)[0]
        for (i, s), row in zip(part, where.ravel().tolist(), strict=True):
            for kind, a, b in _spans(tags[row]):
                whole = (a > 0 or s == 0) and (b < WINDOW or s + WINDOW >= len(texts[i]))
                if whole and s + b <= len(texts[i]):
                    sure = float(p[row, np.arange(a, b), tags[row, a:b]].mean())
                    key = kind, s + a, s + b
                    found[i][key] = max(found[i].get(key, 0.0), sure)
    return [_reconciled(f) for f in found]


def _spans(tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    firsts = np.flatnonzero(tags % 2 == 1)
    for a in firsts.tolist():
        b = a + 1
        while b < len(tags) and tags[b] == tags[a] + 1:
            b += 1
        yield KINDS[(tags[a] - 1) // 2], a, b


def _possible(kind: str, found: str) -> bool:
    """A card's digits have a checksum; one that fails is no card, however alike it looks."""
    return kind != "card" or luhn("".join(c for c in found if c in "0123456789"))


def _reconciled(found: dict[tuple[str, int, int], float]) -> list[tuple[str, int, int, float]]:
    """The set of spans without overlap whose confidences, by length, sum up highest."""
    rows = sorted(((b, a, kind, sure) for (kind, a, b), sure in found.items()))
    ends = [r[0] for r in rows]
    # For each number of spans looked at: the best sum, and the last span taken for it with what came before.
    best, taken = [0.0], [None]
    for n, (b, a, kind, sure) in enumerate(rows):
        k = bisect_right(ends, a, 0, n)
        with_it = best[k] + sure * (b - a)
        better = with_it > best[-1]
        best.append(with_it if better else best[-1])
        taken.append(((kind, a, b, sure), taken[k]) if better else taken[-1])
    chosen, link = [], taken[-1]
    while link is not None:
        span, link = link
        chosen.append(span)
    return chosen[::-1]


def training_windows(docs: DataFrame, text: str = "text", limit: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of at most ``limit`` windows, chosen by hash from all documents.

    A third has no span, a third the spans of the patterns, a third the same rewritten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                content, tagged, some = [], [], []
                for raw in piece.column(0).to_pylist():
                    if not _HINT.search(raw):
                        continue
                    plain = raw.decode(errors="replace")
                    spans = base_spans(plain)
                    for sort, (whole, known) in enumerate([(plain, spans), *([varied(plain, spans)] if spans else [])], 1):
                        coded, tags = classes(whole), _tags(len(whole), known)
                        for s in windows(whole):
                            y = tags[s : s + WINDOW]
                            if (y[0] % 2 == 0 and y[0]) or (sort == 2 and not y.any()):
                                continue
                            content.append(coded[s : s + WINDOW].astype(np.uint8).tobytes())
                            tagged.append(y.astype(np.uint8).tobytes())
                            some.append(sort if y.any() else 0)
                yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(tagged, pa.binary()), pa.array(some, pa.int32())], names=["x", "y", "some"])

    source = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(TEXT))
    found = source.mapInArrow(run, "x binary, y binary, some int")
    ranked = written(found.groupBy("x", "y", "some").agg(F.xxhash64("x", "y").alias("h")), "windows")
    rows = []
    for some in (1, 2, 0):
        rows += ranked.filter(F.col("some") == some).orderBy("h", "x", "y").limit(limit // 3).collect()
    x = np.full((len(rows), WINDOW), _PAD, np.int64)
    y = np.zeros((len(rows), WINDOW), np.int64)
    for i, row in enumerate(rows):
        x[i, : len(row["x"])] = np.frombuffer(row["x"], np.uint8)
        y[i, : len(row["y"])] = np.frombuffer(row["y"], np.uint8)
    return x, y


def fit(docs: DataFrame, text: str = "text", limit: int = SAMPLE_WINDOWS) -> Network | None:
    x, y = training_windows(docs, text, limit)
    return train(x, y) if len(x) and y.any() else None


def find_personal_data(docs: DataFrame, net: Network | None, text: str = "text", confidence: float = CONFIDENCE, drop_text: bool = False) -> DataFrame:
    """Each row with ``base_spans`` of the patterns and ``spans``, those and what the network adds, by kind and start."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def rows(spans: list[tuple[str, int, int]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))]

    def work(texts: pa.Array) -> dict:
        raw = texts.to_pylist()
        hinted = [i for i, t in enumerate(raw) if _HINT.search(t)]
        contents = [raw[i].decode(errors="replace") for i in hinted]
        tagged = decode(sent.value, contents) if sent.value is not None else [[] for _ in hinted]
        base: list[list] = [[] for _ in raw]
        all_: list[list] = [[] for _ in raw]
        for i, content, more in zip(hinted, contents, tagged, strict=True):
            fixed = base_spans(content)
            taken = np.zeros(len(content) + 1, bool)
            for _, a, b in fixed:
                taken[a:b] = True
            added = [
                (k, a, b) for k, a, b, sure in more if sure >= confidence and not taken[a:b].any() and _possible(k, content[a:b])
            ]
            base[i], all_[i] = rows(fixed), rows(fixed + added)
        return {"base_spans": base, "spans": all_}

    return map_texts(docs, work, f"base_spans {SPAN}, spans {SPAN}", text, drop_text=drop_text)
