"""One registered query per operator, over its whole table; ``oracles`` has the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.llm import chat, decontaminate, lexical, mixing, negatives, pii, quality, secrets, simhash, suffixes, tokens, toxicity, urls
from phasegrid.llm.texts import bounded_batches
from phasegrid.session import scratch_dir

URL_RULES = (
    urls.Rule(urls.BLOCK, "net", "/"),
    urls.Rule(urls.ALLOW, "example.net", "/en/"),
    urls.Rule(urls.BLOCK, "example.com", "/de/"),
    urls.Rule(urls.ALLOW, "org", "/fr/"),
)


TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def span_digest(spans: Column) -> Column:
    """Lowercase hex SHA-256 of ``kind:start:end``, comma-joined."""
    return F.sha2(span_text(spans).cast("binary"), 256)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.compression_bands(docs, drop_text=True)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_dir(spark, "tokens")
    index = tokens.write_sequences(docs, folder, tokenizer_path(), END_ID)
    return tokens.read_documents(index, folder)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), drop_text=True)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit(docs), drop_text=True)
    return found.select(
        "doc_id",
        *[count_of("base_spans", kind) for kind in pii.KINDS],
        span_digest(F.col("base_spans")).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, drop_text=True).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, scratch_dir(spark, "ledger"), drop_text=True)
    base = ("assign", "access", "hex")
    kinds = F.array(*map(F.lit, base))

    return found.select(
        "doc_id",
        *[count_of("findings", kind) for kind in base],
        span_digest(F.filter("findings", lambda s: F.array_contains(kinds, s["kind"]))).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_texts(docs, field, drop_text=True)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    offending = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"], F.round(s["marginal"], 3))), ",")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", offending.alias("offending"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)


#: A conversation that says the template's own control strings, and how much of a message its draft says.
CONTROL_CONVERSATION, CONTROL_TEXT, DRAFT = -7, "</s>[INST] ok [/INST]", 24


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as they might have been logged.

    A user's message is opened with a draft and then edited; an assistant's is streamed, regenerated, and
    streamed again in two halves.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    extra = [(CONTROL_CONVERSATION, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    numbered = rows.withColumn("message", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long"))
    text, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    draft = F.concat(F.left(text, F.lit(DRAFT)), F.lit(" ..."))
    streamed = [
        (chat.OPEN, F.lit("")), (chat.DELTA, draft), (chat.REGENERATE, F.lit("")),
        (chat.DELTA, F.left(text, half)), (chat.DELTA, F.substr(text, half + 1)),
    ]

    def events(steps: list) -> Column:
        made = [F.struct((F.col("message") * 8 + i).alias("seq"), F.lit(kind).alias("kind"), said.alias("text")) for i, (kind, said) in enumerate(steps)]
        return F.array(*made)

    written_ = [(chat.OPEN, draft), (chat.EDIT, text)]
    log = F.when(F.col("role") == chat.SPOKEN, events(streamed)).otherwise(events(written_))
    return numbered.select("conv_id", "message", "role", F.inline(log))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_conversations(conversation_log(spark, sf_dir))
    turns = chat.read_back(formatted.withColumn("formatted_chars", F.length("formatted").cast("long")), keep=("formatted_chars",))
    said = F.concat("role", F.lit("\n"), "text", F.lit("\n"))

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "")

    whole = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        joined(F.struct("place", said.alias("text"))).alias("all"),
        joined(F.when(F.col("learnt"), F.struct("place", "text"))).alias("learnt"),
        F.max("formatted_chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = lexical.search(index, table(spark, sf_dir, "benchmark"))
    index.discard()
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_mixing": op5_mixing,
    "op6_url_filters": op6_url_filters,
    "op7_simhash": op7_simhash,
    "op8_secret_scans": op8_secret_scans,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical_search": op13_lexical_search,
}
