"""The corpus pipeline: quality, near-duplicates, benchmark contamination, source mix, token files.

Each stage takes what its predecessor kept as a table with the columns of ``documents`` and returns such
a table; the last returns where each document's ids lie in the token files. Extra columns go along,
whatever their names. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import decontaminate, mixing, quality, simhash, tokens
from phasegrid.llm.queries import END_ID, table, tokenizer_path
from phasegrid.llm.scratch import written
from phasegrid.session import scratch_dir


def _kept(docs: DataFrame, work: Callable[..., DataFrame], **names: str) -> DataFrame:
    """Rows that ``work`` returns for ``docs`` under column names of our own, so that none clashes."""
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    done = work(docs.toDF(*own.values()), **{k: own[v] for k, v in names.items()})
    return done.select(*own.values()).toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and compress as texts of their length do."""
    return _kept(docs, lambda d, text: quality.compression_bands(d, text).filter("kept"), text="text")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return _kept(docs, simhash.one_of_each, key="doc_id", text="text")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others spans longer than the limit are cut."""

    def work(d: DataFrame, text: str) -> DataFrame:
        found = decontaminate.decontaminate(d, table(spark, sf_dir, "benchmark"), text)
        clean = F.when(F.col("n_hit") > decontaminate.SPAN_WORDS, F.col("clean_text")).otherwise(F.col(text))
        return found.filter("NOT contaminated").withColumn(text, clean)

    return _kept(docs, work, text="text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for."""
    return _kept(docs, lambda d, **names: mixing.repeated(mixing.mix(d, **names)), key="doc_id", source="source", text="text")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns start, length and checksum of each document's ids."""
    folder = scratch_dir(spark, "corpus")
    index = tokens.write_sequences(docs.select("doc_id", "text"), folder, tokenizer_path(), END_ID)
    return tokens.read_documents(index, folder)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: Compression ratios, XXH64 and the tokenizer are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
