"""Whole texts as Arrow buffers inside a task, and the frame plumbing the operators share.

A null text counts as an empty one. A result column replaces an input column of the same name
(names compare without case).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 8 << 20
BATCH_BYTES = 16 << 20
TEXT = "__text"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Have Spark hand texts to Python in batches of bounded bytes, whatever the length of the rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` that none of the result ``names`` replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(
    df: DataFrame,
    work: Callable[[pa.Array], dict],
    result: str,
    text: str = "text",
    drop_text: bool = False,
    given: tuple[str, ...] = (),
) -> DataFrame:
    """Append to each row the columns ``result`` (DDL) that ``work`` computes from a bounded run of texts.

    ``work`` gets a large_binary array without nulls, and the columns ``given``, which then go, and
    returns one sequence per result column. Rows stay in their tasks.
    """
    fields = T.StructType.fromDDL(result)
    names = fields.fieldNames()
    kept = [c for c in without(df, [*names, *given]) if not (drop_text and c == text)]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.select(*map(quoted, kept)).schema] + fields.fields)
    source = df.select(*map(quoted, [*kept, *given]), F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b"")).alias(TEXT))
    types = [(f.name, _arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                extra = [piece.column(len(kept) + i) for i in range(len(given))]
                made = work(piece.column(piece.num_columns - 1).cast(pa.large_binary()), *extra)
                columns = [piece.column(i) for i in range(len(kept))]
                columns += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], t) for n, t in types]
                yield pa.RecordBatch.from_arrays(columns, names=kept + names)
                del made, columns
                pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return simple[kind.simpleString()]


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch whose last column is binary into runs of at most ``PIECE_BYTES`` (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a run of texts, as numbers into the dictionary of distinct words.

    ``fold`` maps each byte to itself, to its lower case or to a space; words are what spaces part.
    """

    def __init__(self, texts: pa.Array, fold: bytes):
        data, ends = buffer_of(texts)
        folded = data.tobytes().translate(fold)
        self.data, self.ends = folded, ends
        strings = pa.Array.from_buffers(
            pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(folded)]
        )
        lists = pc.ascii_split_whitespace(strings)
        flat = lists.flatten()
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        # Words before each text: list offsets count the empty strings at the edges too.
        before = np.concatenate([[0], np.cumsum(real)])
        at = lists.offsets.to_numpy().astype(np.int64)
        self.starts = before[at - at[0]]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``; 0 for an empty text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Only the six ASCII white-space characters part words.
SPACED = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: The same, with A-Z lower-cased.
SPACED_LOWER = SPACED.translate(bytes.maketrans(_UPPER, _LOWER))
#: Words are 0-9, a-z (A-Z lower-cased) and everything beyond ASCII.
ALPHANUMERIC_LOWER = bytes(
    b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
