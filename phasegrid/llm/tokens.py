"""Token ids as Arrow files of equal-length sequences.

``write_sequences`` deals the documents out by ascending key, encodes them and packs each range of keys
into Arrow IPC files (the random-access file format, uncompressed): record batches with the columns
``ids`` and ``mask``, both fixed-size lists. A file is one stream of ids cut into sequences; only its
last sequence is padded, with mask false. ``SequenceFile`` maps a file and gives any sequence, or any
run of ids, without copying. The index, a table, tells where each document lies.

A file is written under a name of its own by each attempt, and the index names the files of the
attempts that succeeded, so a repeated task leaves at most a file that nobody reads.

Cases: a null text is empty and yields its end id alone; null keys come first; rows that repeat a key
are all written, by the hash of their text; an empty table writes an empty index and no file.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasegrid.llm.scratch import with_places
from phasegrid.llm.texts import SPACED, TEXT, Words, per_text, pieces, quoted

SEQUENCE = 1024
BATCH_SEQUENCES = 256
FILE_BATCHES = 128
#: Words whose ids a worker keeps for later texts.
REMEMBERED = 250_000
_PLAIN = re.compile(rb"[A-Za-z]+\Z")
_JOINED = 256


def _parts_of(path: str) -> regex.Pattern | None:
    """The expression by which a tokenizer file cuts words into parts, if it has one."""
    with open(path, encoding="utf-8") as file:
        cutting = json.load(file).get("pre_tokenizer") or {}
    for step in cutting.get("pretokenizers", [cutting]):
        if step.get("type") == "Split" and step.get("invert") and "Regex" in step["pattern"]:
            return regex.compile(step["pattern"]["Regex"])
    return None


class WordEncoder:
    """Ids of whole texts from a tokenizer that splits at white space and drops it.

    The ids of a text are then those of its words in turn, so each distinct word is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for token, code in self.tokenizer.get_vocab().items():
            self.ends[code] = token.endswith("</w>")
        self.parts = _parts_of(path)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _closing(self, word: str) -> int:
        """How many ids of a word close a part of it; 0 if that is not known beforehand."""
        if self.parts is None or "<|" in word or not unicodedata.is_normalized("NFC", word):
            return 0
        return len(self.parts.findall(word.lower()))

    def _learn(self, words: list[bytes]) -> None:
        # The tokenizer closes each part of a word with an id of its kind. Where the number of parts is known,
        # many words are encoded as one text and cut apart after so many closing ids.
        counted = [(w, 1 if _PLAIN.match(w) else self._closing(w.decode())) for w in words]
        joined = [(w, n) for w, n in counted if n]
        other = [w for w, n in counted if not n]
        runs = [joined[i : i + _JOINED] for i in range(0, len(joined), _JOINED)]
        for run, ids in zip(runs, self._encode([b" ".join([w for w, _ in r]).decode() for r in runs]), strict=True):
            coded = np.array(ids, self.type)
            last = np.flatnonzero(self.ends[coded]) + 1
            parts = np.cumsum([n for _, n in run])
            if len(last) != parts[-1] or last[-1] != len(coded):
                other += [w for w, _ in run]
                continue
            flat, width, at = coded.tobytes(), self.type.itemsize, 0
            for (word, _), end in zip(run, (last[parts - 1] * width).tolist(), strict=True):
                self.known[word] = flat[at:end]
                at = end
        for word, ids in zip(other, self._encode([w.decode() for w in other]), strict=True):
            self.known[word] = np.array(ids, self.type).tobytes()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text closed by ``end_id``, and how many each has."""
        words = Words(texts, SPACED)
        distinct = words.values.cast(pa.large_binary()).to_pylist()
        if len(self.known) > REMEMBERED:
            # Words of the present texts stay, above all the frequent ones.
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        self._learn([w for w in distinct if w not in self.known])
        coded = [self.known[w] for w in distinct] + [np.array([end_id], self.type).tobytes()]
        pool = np.frombuffer(b"".join(coded), self.type)
        sizes = np.array([len(c) for c in coded], np.int64) // self.type.itemsize
        firsts = np.cumsum(sizes) - sizes
        stream = np.insert(words.ids, words.starts[1:], len(distinct))
        lengths = sizes[stream]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(firsts[stream] - before, lengths)
        at += np.arange(len(at))
        return pool[at], per_text(sizes[words.ids], words.starts) + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and path of a URI; ``s3a`` and ``s3n`` mean ``s3`` to Arrow."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class _Writer:
    """Packs ids into the sequences of one file after another."""

    def __init__(self, folder: str, part: int, sequence: int, kind: np.dtype):
        self.folder, self.part, self.sequence = folder, part, sequence
        self.kind = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(self.kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.file = None
        self.waiting: list[np.ndarray] = []
        self.held = self.size = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        if self.file is None:
            self.name = f"part-{self.part:06d}-{uuid.uuid4().hex}.arrow"
            system, path = file_system(f"{self.folder}/{self.name}")
            self.sink = system.open_output_stream(path)
            self.file, self.size = pa.ipc.new_file(self.sink, self.schema), 0
        self.waiting.append(ids)
        self.held += len(ids)
        self.size += len(ids)
        self.total += len(ids)
        step = BATCH_SEQUENCES * self.sequence
        if self.held >= step:
            held = np.concatenate(self.waiting)
            whole = self.held - self.held % step
            for at in range(0, whole, step):
                self._write(held[at : at + step], step)
            self.waiting, self.held = [held[whole:]], self.held - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.sequence)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.sequence)
        self.file.write_batch(pa.RecordBatch.from_arrays([lists, mask], schema=self.schema))

    def full(self) -> bool:
        return self.file is not None and self.size >= FILE_BATCHES * BATCH_SEQUENCES * self.sequence

    def close(self) -> None:
        if self.file is None:
            return
        if self.held:
            held = np.concatenate(self.waiting)
            room = np.zeros(-self.held % self.sequence, held.dtype)
            self._write(np.concatenate([held, room]), self.held)
        self.waiting, self.held = [], 0
        self.file.close()
        self.sink.close()
        self.file = None


def write_sequences(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE
) -> DataFrame:
    """Write the files below ``folder`` and return the index: key, start, n_tokens, file, file_start.

    ``start`` counts the ids of all documents before this one, ``file_start`` those in its file.
    """
    spark = docs.sparkSession
    system, path = file_system(f"{folder}/sequences")
    system.create_dir(path, recursive=True)
    content = F.coalesce(F.col(quoted(text)).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(quoted(key)), F.xxhash64(content).alias("__hash"), F.monotonically_increasing_id().alias("__row"), content.alias(TEXT))
    order = [F.col(quoted(key)).asc_nulls_first(), F.col("__hash"), F.col("__row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(quoted(key), TEXT)
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("part int, place long, n_tokens long, file string, file_start long")])
    ranged.mapInArrow(_writing(f"{folder}/sequences", tokenizer, end_id, sequence), schema).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    index = spark.read.parquet(f"{folder}/index")
    return with_places(index, F.col("part"), F.col("place"), F.col("n_tokens"), "start").drop("part", "place")


def _writing(folder: str, tokenizer: str, end_id: int, sequence: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        writer = _Writer(folder, part, sequence, encode.type)
        for batch in batches:
            for piece in pieces(batch):
                ids, counts = encode.encode(piece.column(1).cast(pa.large_binary()), end_id)
                places, files, offsets, at = [], [], [], 0
                ends = np.cumsum(counts).tolist()
                # Documents are added in runs; a file is full only between documents.
                for end in ends:
                    if writer.full():
                        writer.close()
                    places.append(writer.total)
                    offsets.append(writer.size if writer.file is not None else 0)
                    writer.add(ids[at:end])
                    files.append(writer.name)
                    at = end
                pa.default_memory_pool().release_unused()
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(counts), pa.array(files), pa.array(offsets, pa.int64())],
                    names=[batch.schema.names[0], "part", "place", "n_tokens", "file", "file_start"],
                )
        writer.close()

    return run


class SequenceFile:
    """A written file, mapped into memory where it is local."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size

    def __len__(self) -> int:
        last = self.reader.num_record_batches - 1
        return last * BATCH_SEQUENCES + self.reader.get_batch(last).num_rows

    def get(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of the sequence ``i``, as views."""
        batch, row = divmod(i, BATCH_SEQUENCES)
        ids, mask = self.reader.get_batch(batch).columns
        at = slice(row * self.sequence, (row + 1) * self.sequence)
        return ids.values.to_numpy()[at], mask.values[at]

    def ids(self, start: int, count: int) -> np.ndarray:
        """A run of the file's ids; a view unless it reaches over a batch."""
        step, found = BATCH_SEQUENCES * self.sequence, []
        while count > 0:
            batch, at = divmod(start, step)
            part = self.reader.get_batch(batch).column(0).values.to_numpy()[at : at + count]
            found.append(part)
            start, count = start + len(part), count - len(part)
        return found[0] if len(found) == 1 else np.concatenate(found)

    def close(self) -> None:
        self.source.close()


def read_documents(index: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the CRC-32 of the ids (32-bit little-endian), read from the files."""
    rows = index.select(quoted(key), "start", "n_tokens", "file", "file_start")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])
    dealt = rows.repartition("file", (F.col("file_start") / (1 << 20)).cast("int")).sortWithinPartitions("file", "file_start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            checks = []
            where = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            for count, wanted, start in where:
                if wanted != name:
                    if file:
                        file.close()
                    name, file = wanted, SequenceFile(f"{folder}/sequences/{wanted}")
                checks.append(zlib.crc32(file.ids(start, count).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(checks, pa.int64())], names=[*batch.schema.names[:3], "ids_crc32"])
        if file:
            file.close()

    return dealt.mapInArrow(run, schema)
