"""Quality rules from word counts and from how well a text compresses.

``compression_bands`` compresses each text whole, and in chunks of fixed size, with zstandard. A
ratio is raw bytes / compressed bytes: repetitive text compresses far too well, random or encoded
text hardly at all. What is usual depends on the length, so the limits are a table by length.

Cases: a null or empty text has no words, ratio 0 and fails the base rules; a last chunk shorter
than half the chunk size is judged with the one before it; equal rows get equal verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from phasegrid.llm.texts import SPACED, Words, buffer_of, map_texts, per_text

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Lowest and highest usual ratio of texts of at least ``from_bytes`` bytes."""

    from_bytes: int
    low: float
    high: float


#: Fixed with margin around what texts labelled good have: 1.03 to 1.74 from 128 bytes on, 1.34 to 1.84 from 256 on, 1.47
#: to 1.97 from 512 on, 1.72 to 2.22 from 1 kB on, 2.12 to 2.48 from 4 kB on. Base64-like words reach 1.21 below 512 bytes,
#: 1.29 below 1 kB, then 1.36; random printable words less. Words said five times over have 2.9 to 4.4 from 256 bytes on,
#: 4.4 to 6.5 from 1 kB on. Below 256 bytes the frame and the code table hide most noise.
BANDS = (
    Band(0, 0.0, 2.8),
    Band(128, 0.97, 2.8),
    Band(256, 1.22, 2.8),
    Band(512, 1.32, 3.1),
    Band(1024, 1.45, 3.5),
    Band(8192, 1.5, 3.8),
    Band(65536, 1.5, 4.2),
)
CHUNK_BYTES = 4096
#: Usual ratios of a chunk (1.99 to 2.29 in texts labelled good), and the share of a text's chunks that may lie outside them.
CHUNK_BAND = (1.45, 3.5)
CHUNK_SHARE = 0.3
LEVEL = 3

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


def compression_bands(
    docs: DataFrame,
    text: str = "text",
    bands: tuple[Band, ...] = BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE,
    level: int = LEVEL,
    drop_text: bool = False,
) -> DataFrame:
    """Each row with its counts, its ratios and the verdict ``kept``; nothing is shuffled."""
    bands = tuple(sorted(bands, key=lambda b: b.from_bytes))

    def work(texts: pa.Array) -> dict:
        made = base_counts(texts)
        made.update(_ratios(texts, bands, chunk_bytes, chunk_band, level))
        usual = made.pop("usual") & (made["n_bad_chunks"] <= chunk_share * made["n_chunks"])
        made["kept"] = usual & ~made["base_failed"]
        return made

    return map_texts(docs, work, RESULT, text, drop_text=drop_text)


def base_counts(texts: pa.Array) -> dict:
    """Counts over words parted by ASCII white space, and the two base rules."""
    data, ends = buffer_of(texts)
    words = Words(texts, SPACED)
    folded = np.frombuffer(words.data, np.uint8)
    n_words = words.counts
    # A byte that continues a character (10xxxxxx) is no character of its own.
    chars = per_text((folded != 32) & ((folded & 0xC0) != 0x80), ends)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    repeated = per_text(_repeated_words(words.ids, words.owners(), words.starts), words.starts)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": per_text(symbol[data], ends),
        "n_dup_lines": [_duplicate_lines(t) for t in texts.to_pylist()],
        "n_repeat_words": repeated,
        "base_failed": (n_words < 20) | (100 * repeated > 30 * n_words),
    }


def _duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _repeated_words(ids: np.ndarray, owners: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks the words inside any ``WINDOW``-word window that its text holds twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < WINDOW + 1:
        return covered
    n = len(ids) - WINDOW + 1
    inside = np.flatnonzero(owners[:n] == owners[WINDOW - 1 :])
    # A random number for each window finds the candidates; their words are then compared.
    draw = np.random.default_rng(7).integers(1, 2**63, int(ids.max()) + 1, np.uint64)
    odd = np.random.default_rng(8).integers(1, 2**63, WINDOW + 1, np.uint64) | np.uint64(1)
    code = owners[inside].astype(np.uint64) * odd[WINDOW]
    for j in range(WINDOW):
        code += draw[ids[inside + j]] * odd[j]
    order = np.argsort(code, kind="stable")
    code = code[order]
    same = code[1:] == code[:-1]
    hot = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(hot):
        return covered
    at = inside[hot]
    rows = np.column_stack([owners[at], *(ids[at + j] for j in range(WINDOW))])
    _, group, size = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    twice = at[size[group.ravel()] > 1]
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, np.minimum(twice + WINDOW, len(ids)), -1)
    return np.cumsum(marks[:-1]) > 0


def _ratios(texts: pa.Array, bands: tuple[Band, ...], chunk: int, chunk_band: tuple[float, float], level: int) -> dict:
    compress = zstandard.ZstdCompressor(level=level).compress
    data, ends = buffer_of(texts)
    view = memoryview(data.tobytes())
    firsts = np.array([b.from_bytes for b in bands])
    ratio, usual, chunks, bad = [], [], [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        size = b - a
        r = size / len(compress(view[a:b])) if size else 0.0
        band = bands[max(0, int(np.searchsorted(firsts, size, "right")) - 1)]
        ratio.append(r)
        usual.append(band.low <= r <= band.high)
        cuts = list(range(a, b, chunk))
        if len(cuts) > 1 and b - cuts[-1] < chunk // 2:
            cuts.pop()
        of_chunks = [(q - p) / len(compress(view[p:q])) for p, q in zip(cuts, [*cuts[1:], b], strict=True)] if size > chunk else []
        chunks.append(len(of_chunks))
        bad.append(sum(not chunk_band[0] <= x <= chunk_band[1] for x in of_chunks))
    return {"ratio": ratio, "usual": np.array(usual, bool), "n_chunks": np.array(chunks, np.int64), "n_bad_chunks": np.array(bad, np.int64)}
