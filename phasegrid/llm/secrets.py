"""Secret scan with a ledger of blobs: every version of a text is scanned once per version of the rules.

A blob is a text, addressed by the SHA-256 of its bytes. The ledger is a table of (rule version,
blob, findings) in a folder. ``scan_new_blobs`` looks at the blobs of a batch that the ledger lacks
under the current rules and appends them; ``find_secrets`` joins the findings back to every row
that holds the blob, whatever its path.

Cases: a null text is the empty blob; copies, in one batch or over many, share a blob and are scanned
once; an empty batch appends nothing; a new rule version scans all blobs again and leaves the old
entries. A batch that failed half-way may be run again: a blob is read once even if listed twice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.texts import quoted, without

FINDING = "array<struct<kind:string,start:bigint,end:bigint>>"
LEDGER = f"rule_version string, blob string, findings {FINDING}"


@dataclass(frozen=True)
class SecretRule:
    """A pattern; group ``part`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    least: int
    part: int = 0


#: Runs shorter than the least length are no match of these patterns, so they ask for it themselves
#: where that finds the same spans; an assignment is matched first and measured then.
RULES = (
    SecretRule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 24),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
)


def version_of(rules: tuple[SecretRule, ...]) -> str:
    """A name for the rules that changes with any of them."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def findings_of(text: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """All spans of all rules in a text, by start, then rule; positions count code points.

    A text split at a pattern gives what lies between its matches; the running length of the parts
    and the matches is where each match starts.
    """
    found = []
    for rule in rules:
        pattern = F.lit(rule.pattern)
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        measured = F.regexp_extract_all(text, pattern, F.lit(rule.part)) if rule.part else matches
        between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
        rows = F.arrays_zip(
            between.alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("size"),
            F.transform(measured, lambda x: F.length(x)).alias("measure"),
        )
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"CAST(array() AS {FINDING})").alias("spans"))
        spans = F.aggregate(rows, start, _next_match(rule), lambda acc: acc["spans"])
        # Texts without a match, most of them, are settled by one search.
        found.append(F.when(text.rlike(rule.pattern), spans).otherwise(F.expr(f"CAST(array() AS {FINDING})")))
    order = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_sort(
        F.concat(*found),
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(
            (F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])).cast("int")
        ),
    )


def _next_match(rule: SecretRule):
    """Fold a (gap, size, measure) row into (position, spans so far)."""

    def step(acc: Column, row: Column) -> Column:
        first = acc["at"] + row["gap"]
        last = first + F.coalesce(row["size"], F.lit(0))
        span = F.struct(F.lit(rule.kind).alias("kind"), first.cast("long").alias("start"), last.cast("long").alias("end"))
        spans = F.when(row["measure"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(last.cast("long").alias("at"), spans.alias("spans"))

    return step


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's entries; a folder without any is an empty ledger."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def scan_new_blobs(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> str:
    """Scan what the ledger has not seen under these rules, append it, and return the rules' version."""
    version = version_of(rules)
    seen = read_ledger(docs.sparkSession, ledger).filter(F.col("rule_version") == version).select("blob")
    content = F.coalesce(F.col(quoted(text)), F.lit(""))
    versions = docs.select(blob_of(content).alias("blob"), content.alias("content"))
    # Copies meet on the map side first: a task sends each blob once.
    unseen = versions.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("content").alias("content"))
    entries = unseen.select(F.lit(version).alias("rule_version"), "blob", findings_of(F.col("content"), rules).alias("findings"))
    entries.write.mode("append").parquet(ledger)
    return version


def find_secrets(docs: DataFrame, ledger: str, text: str = "text", rules: tuple[SecretRule, ...] = RULES, drop_text: bool = False) -> DataFrame:
    """Each row with its ``blob`` and ``findings``; scans first what is new."""
    version = scan_new_blobs(docs, ledger, text, rules)
    found = (
        read_ledger(docs.sparkSession, ledger)
        .filter((F.col("rule_version") == version) & (F.size("findings") > 0))
        .groupBy("blob")
        .agg(F.first("findings").alias("findings"))
        .withColumnRenamed("blob", "__blob")
    )
    kept = [c for c in without(docs, ["blob", "findings"]) if not (drop_text and c == text)]
    rows = docs.select(*[F.col(quoted(c)) for c in kept], blob_of(F.col(quoted(text))).alias("blob"))
    joined = rows.join(found, F.col("blob") == F.col("__blob"), "left").drop("__blob")
    return joined.withColumn("findings", F.coalesce("findings", F.expr(f"CAST(array() AS {FINDING})")))
