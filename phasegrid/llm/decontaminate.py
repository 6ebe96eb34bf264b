"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words form one automaton, whose states know which items hold their 13-word windows. The
words of a document run through it; the longest match that ends at each word tells which words lie in
an occurrence of a window, and of which items. Spans of such words are cut where they exceed
the span limit, whole documents are flagged where the covered share reaches the coverage limit.

An automaton holds a block of at most ``BLOCK_WORDS`` item words, so what is sent to the tasks is
bounded; a larger benchmark takes more passes over the documents. A longer item is cut into parts
that overlap by a window less one word, which loses no window.

Cases: null or empty texts have no words and no hits; items without words are ignored; an item shorter
than a window is one window; rows with the same item id count as one item; a null item id counts
as the empty string; equal documents get equal results; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.scratch import written
from phasegrid.llm.texts import ALPHANUMERIC_LOWER, Words, map_texts, per_text, quoted, without

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20
#: Runs of hit words longer than this are cut out of documents that stay.
SPAN_WORDS = 26
BLOCK_WORDS = 100_000

RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


class Automaton:
    """Generalised suffix automaton over word sequences; words are numbers from 1."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.words: dict[bytes, int] = {}
        self.ends: dict[int, set[str]] = {}
        self.shorts: list[tuple[tuple[int, ...], str]] = []

    def add(self, item: str, words: list[bytes]) -> None:
        """Append an item (or a part of one) as a sequence of its own."""
        if not words:
            return
        codes = [self.words.setdefault(w, len(self.words) + 1) for w in words]
        if len(codes) < self.window:
            self.shorts.append((tuple(codes), item))
        last = 0
        for n, code in enumerate(codes, 1):
            last = self._extend(last, code)
            if n >= self.window:
                self.ends.setdefault(last, set()).add(item)

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, code, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and code not in self.next[p]:
            self.next[p][code] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][code]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, code, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.next.append(following)
        return len(self.length) - 1

    def _clone(self, p: int, code: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        return clone

    def finish(self) -> Automaton:
        """Work out, for each state, the items that a match ending there reveals."""
        w = self.window
        # Items of a window live at the one state on the link path whose lengths span the window.
        held: dict[int, set[str]] = {}
        for state in sorted(range(len(self.length)), key=lambda s: -self.length[s]):
            items = self.ends.get(state)
            if not items:
                continue
            parent = self.link[state]
            if self.length[state] >= w > self.length[parent]:
                held[state] = items
            elif parent > 0:
                self.ends.setdefault(parent, set()).update(items)
        self.at_window = [-1] * len(self.length)
        self.short_at: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        own: dict[int, list[tuple[int, str]]] = {}
        for codes, item in self.shorts:
            state = 0
            for code in codes:
                state = self.next[state][code]
            own.setdefault(state, []).append((len(codes), item))
        for state in sorted(range(1, len(self.length)), key=lambda s: self.length[s]):
            parent = self.link[state]
            self.at_window[state] = state if state in held else self.at_window[parent] if parent > 0 else -1
            above = self.short_at[parent] if parent > 0 else ()
            self.short_at[state] = (*own[state], *above) if state in own else above
        self.items = {s: tuple(sorted(i)) for s, i in held.items()}
        self.least = min([w, *(len(c) for c, _ in self.shorts)])
        pairs = {(a, b) for following in self.next for a, s in following.items() for b in self.next[s]}
        self.pairs = np.array(sorted(a * (len(self.words) + 1) + b for a, b in pairs), np.int64)
        del self.ends
        return self

    def match(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, longest match that ends there, state) over a run of known words."""
        state, length = 0, 0
        following, link, lengths = self.next, self.link, self.length
        for i, code in enumerate(codes):
            while state and code not in following[state]:
                state = link[state]
                length = lengths[state]
            to = following[state].get(code)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield i, length, state


def item_blocks(benchmark: DataFrame, item: str, text: str, window: int, limit: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark, read row by row, as blocks of at most ``limit`` words."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(quoted(item)).cast("string"), F.lit("")), F.col(quoted(text)))
    for name, content in rows.toLocalIterator(prefetchPartitions=False):
        words = (content or "").encode().translate(ALPHANUMERIC_LOWER).split(b" ")
        words = [w for w in words if w]
        step = limit - window + 1
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + limit]
            if block and size + len(part) > limit:
                yield block
                block, size = [], 0
            block.append((name, part))
            size += len(part)
    if block:
        yield block


def hits(texts: pa.Array, automaton: Automaton) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of the texts, which of them lie in a window, and the items found in each text."""
    words = Words(texts, ALPHANUMERIC_LOWER)
    covered = np.zeros(len(words.ids) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(len(texts))]
    known = np.array([automaton.words.get(v, 0) for v in words.values.cast(pa.large_binary()).to_pylist()], np.int64)
    codes = known[words.ids] if len(words.ids) else words.ids
    if not len(codes) or not len(automaton.words):
        return words, np.zeros(len(words.ids), bool), found
    # Only a run of words whose neighbours are neighbours in some item can hold a match that long.
    least, owners = automaton.least, words.owners()
    pair = codes[:-1] * (len(automaton.words) + 1) + codes[1:]
    at = np.minimum(np.searchsorted(automaton.pairs, pair), max(0, len(automaton.pairs) - 1))
    joined = (automaton.pairs[at] == pair if len(automaton.pairs) else np.zeros(len(pair), bool)) & (owners[:-1] == owners[1:])
    joined &= (codes[:-1] > 0) & (codes[1:] > 0)
    breaks = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(codes)]])
    long = np.flatnonzero(np.diff(breaks) >= least)
    for start, stop in zip(breaks[long].tolist(), breaks[long + 1].tolist(), strict=True):
        if stop - start == 1 and not codes[start]:
            continue
        items = found[owners[start]]
        for i, length, state in automaton.match(codes[start:stop].tolist()):
            if length >= automaton.window:
                covered[start + i + 1 - length] += 1
                covered[start + i + 1] -= 1
                items.update(automaton.items[automaton.at_window[state]])
            for size, name in automaton.short_at[state]:
                if size <= length:
                    covered[start + i + 1 - size] += 1
                    covered[start + i + 1] -= 1
                    items.add(name)
    return words, np.cumsum(covered[:-1]) > 0, found


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    span_words: int = SPAN_WORDS,
    block_words: int = BLOCK_WORDS,
    drop_text: bool = False,
) -> DataFrame:
    """Each row with ``n_words, n_hit, n_items, items_sha256, contaminated``, and its text without long spans.

    ``clean_text`` is the text without the runs of more than ``span_words`` hit words; it is left out
    with ``drop_text``.
    """
    kept = [c for c in without(docs, [*RESULT, "clean_text"]) if not (drop_text and c == text)]
    state = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).alias("__content")).selectExpr(
        "*", "CAST(NULL AS BINARY) AS __hits", "CAST(array() AS array<string>) AS __items"
    )
    blocks = item_blocks(benchmark, item, item_text, window, max(block_words, 2 * window))
    block, more = next(blocks, []), next(blocks, None)
    while more is not None:
        # What one block found goes along to the next; the documents are written in between.
        state = written(_pass(state, block, window, None), "hits")
        block, more = more, next(blocks, None)
    return _pass(state, block, window, (coverage, span_words, not drop_text))


def _pass(state: DataFrame, block: list, window: int, last: tuple[int, int, bool] | None) -> DataFrame:
    """Run all documents through the automaton of one block; after the last, sum up."""
    sent = state.sparkSession.sparkContext.broadcast(block)
    given = ("__hits", "__items")
    made: list[Automaton] = []

    def automaton() -> Automaton:
        if not made:
            new = Automaton(window)
            for name, words in sent.value:
                new.add(name, words)
            made.append(new.finish())
        return made[0]

    def search(texts: pa.Array, before: pa.Array, names: pa.Array) -> tuple[Words, np.ndarray, list[set[str]]]:
        words, covered, found = hits(texts, automaton())
        for i, (bits, items) in enumerate(zip(before.to_pylist(), names.to_pylist(), strict=True)):
            if bits:
                a, b = words.starts[i : i + 2].tolist()
                covered[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
            found[i].update(items)
        return words, covered, found

    def carry(texts: pa.Array, before: pa.Array, names: pa.Array) -> dict:
        words, covered, found = search(texts, before, names)
        cuts = zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)
        return {"__hits": [np.packbits(covered[a:b]).tobytes() if covered[a:b].any() else None for a, b in cuts], "__items": [sorted(f) for f in found]}

    def conclude(texts: pa.Array, before: pa.Array, names: pa.Array) -> dict:
        coverage, span_words, clean = last
        words, covered, found = search(texts, before, names)
        n_hit = per_text(covered, words.starts)
        result = {
            "n_words": words.counts,
            "n_hit": n_hit,
            "n_items": [len(f) for f in found],
            "items_sha256": [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found],
            "contaminated": (n_hit > 0) & (coverage * n_hit >= words.counts),
        }
        if clean:
            result["clean_text"] = [
                (_cut(t, covered[words.starts[i] : words.starts[i + 1]], span_words) if n_hit[i] > span_words else t).decode(errors="replace")
                for i, t in enumerate(texts.to_pylist())
            ]
        return result

    if last is None:
        return map_texts(state, carry, "__hits binary, __items array<string>", "__content", given=given)
    ddl = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return map_texts(state, conclude, ddl + ", clean_text string" * last[2], "__content", drop_text=True, given=given)


def _cut(text: bytes, covered: np.ndarray, span_words: int) -> bytes:
    """The text without the runs of more than ``span_words`` covered words."""
    space = np.frombuffer(text.translate(ALPHANUMERIC_LOWER), np.uint8) == 32
    inner = np.concatenate([[True], space, [True]])
    first, after = np.flatnonzero(inner[:-1] & ~inner[1:]), np.flatnonzero(~inner[:-1] & inner[1:])
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        if b - a > span_words:
            kept.append(text[at : first[a]])
            at = int(after[b - 1])
    return b"".join([*kept, text[at:]])
