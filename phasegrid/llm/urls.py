"""Host and path rules for URLs, and gradient-boosted trees for the URLs no rule covers.

The trees see lexical features only: lengths, depth, digit ratio, entropy, parameter counts and the
statistics of what the host, its last two labels and the path's first segment end in. They are grown
from the URLs that rules decide. A suffix's share of blocked URLs is a statistic of labels, so the URLs
that the trees are grown from get it out of fold: counted over the labelled URLs of the other folds.
A boosting step is one aggregation of gradients by feature and bin; what reaches the driver is one row
per node, feature and bin. Scoring is one expression of built-in functions.

Cases: a null URL, or one without ``://``, has an empty host and path; no rule fits it, the trees
judge it. Without any labelled URL the verdict is ``allow``; with one class, that class. Equal URLs
get equal verdicts; they share a fold, so copies of a URL do not tell each other's label. A suffix no
labelled URL has gets the share of one half. URLs of any length are read whole. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.scratch import written
from phasegrid.llm.texts import quoted, without

BLOCK, ALLOW = "block", "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host, with its subdomains, and the start of the path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Boosting:
    """``sample`` bounds the labelled URLs that the trees are grown from, chosen by hash.

    Each tree does without one feature in ``spared``, in turn, so that no feature alone decides.
    """

    rounds: int = 10
    depth: int = 2
    spared: int = 3
    bins: int = 12
    rate: float = 0.4
    smoothing: float = 1.0
    sample: int = 20_000
    folds: int = 5


@dataclass(frozen=True)
class Trees:
    """SQL for the log-odds of ``block``, and what each feature's cuts gained, as shares of the whole."""

    score: str
    gains: dict[str, float]


#: Kinds of suffix with statistics of their own: the last label, the last two, and these with the first path segment.
SUFFIXES = ("label", "domain", "section")
FEATURES = (
    "url_length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens",
    *[f"{k}_{s}" for k in SUFFIXES for s in ("block_rate", "log_count")],
)
#: Entropy is over these characters, each a class, and one class for all others.
CLASSES = _LOWER + "0123456789" + "/.-_=&?%:#"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls. The rules are a short list, not data."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", boosting: Boosting = Boosting()) -> DataFrame:
    """Each row with ``host, path, rule, verdict`` and ``block_score`` of the trees."""
    result = ["host", "path", "rule", "verdict", "block_score"]
    kept = without(pages, result)
    host, path = host_and_path(F.col(quoted(url)))
    parts = pages.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(url)).alias("__url"), host.alias("__host"), path.alias("__path"))
    text, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    judged = parts.select("*", text.alias("__rule"), verdict.alias("__verdict"))
    labelled = judged.filter("__verdict IS NOT NULL").withColumn("__label", (F.col("__verdict") == BLOCK).cast("double"))
    trees, stats = learn(labelled, boosting)
    scored = with_features(judged, stats)
    return scored.select(
        *map(quoted, kept),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__verdict", F.expr(f"IF({trees.score} > 0, '{BLOCK}', '{ALLOW}')")).alias("verdict"),
        F.expr(f"1 / (1 + exp(-({trees.score})))").alias("block_score"),
    )


def learn(labelled: DataFrame, boosting: Boosting = Boosting()) -> tuple[Trees, DataFrame]:
    """Trees and suffix statistics from rows with ``__url, __host, __path, __label``."""
    fold = F.pmod(F.xxhash64("__url", F.lit(11)), F.lit(boosting.folds))
    labelled = labelled.select("__url", "__host", "__path", "__label", fold.alias("__fold"))
    counts = written(suffix_counts(labelled), "suffixes")
    chosen = labelled.orderBy(F.xxhash64("__url"), "__url").limit(boosting.sample)
    training = with_features(chosen, counts, held_out=True).select("__label", *FEATURES)
    return grow(written(training, "urls"), boosting), counts


def suffixes(host: Column, path: Column) -> Column:
    """For each of ``SUFFIXES`` its kind and text."""
    domain = F.substring_index(host, ".", -2)
    section = F.concat(domain, F.lit("/"), F.substring_index(F.substring(path, 2, 1 << 30), "/", 1))
    texts = (F.substring_index(host, ".", -1), domain, section)
    return F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in zip(SUFFIXES, texts, strict=True)])


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """By kind, suffix and fold: how many labelled URLs, and how many blocked ones, have it; over all of them.

    A row per suffix, with its folds as a map, so that looking it up multiplies no rows.
    """
    each = labelled.select("__fold", "__label", F.inline(suffixes(F.col("__host"), F.col("__path"))))
    by_fold = each.groupBy("kind", "text", "__fold").agg(F.count("*").cast("double").alias("n"), F.sum("__label").alias("blocked"))
    return by_fold.groupBy("kind", "text").agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("__fold", F.struct("n", "blocked")))).alias("folds")
    )


def with_features(df: DataFrame, counts: DataFrame, held_out: bool = False) -> DataFrame:
    """Add ``FEATURES`` to rows with ``__url, __host, __path``; ``held_out`` leaves a row's own ``__fold`` out of the counts."""
    url = F.coalesce(F.col("__url"), F.lit(""))
    length = F.length(url).cast("double")
    lower = F.translate(url, _UPPER, _LOWER)

    def count(column: Column, characters: str) -> Column:
        return (F.length(column) - F.length(F.translate(column, characters, ""))).cast("double")

    known = df.withColumn("__counts", F.array(*[count(lower, c) for c in CLASSES]))
    rest = length - F.aggregate("__counts", F.lit(0.0), lambda a, b: a + b)
    nlogn = F.aggregate(F.concat("__counts", F.array(rest)), F.lit(0.0), lambda a, n: a + F.when(n > 0, n * F.log2(n)).otherwise(0.0))
    entropy = F.when(length > 0, F.log2(length) - nlogn / length).otherwise(0.0)
    query = F.when(url.contains("?"), F.substring_index(F.substring_index(url, "?", -1), "#", 1))
    added = known.select(
        "*",
        length.alias("url_length"),
        F.length("__host").cast("double").alias("host_length"),
        F.length("__path").cast("double").alias("path_length"),
        (count(F.col("__host"), ".") + 1).alias("labels"),
        count(F.col("__path"), "/").alias("depth"),
        F.when(length > 0, count(url, "0123456789") / length).otherwise(0.0).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.coalesce(count(query, "&") + 1, F.lit(0.0)).alias("parameters"),
        count(F.col("__host"), "-").alias("hyphens"),
    )
    for i, kind in enumerate(SUFFIXES):
        of_kind = counts.filter(F.col("kind") == kind).select(F.col("text").alias("__text"), "n", "blocked", "folds")
        added = added.withColumn("__key", suffixes(F.col("__host"), F.col("__path"))[i]["text"])
        added = added.join(of_kind, added["__key"] == of_kind["__text"], "left")
        own = F.col("folds")[F.col("__fold")] if held_out else None
        n, blocked = (F.coalesce(F.col(c), F.lit(0.0)) - (F.coalesce(own[c], F.lit(0.0)) if held_out else 0.0) for c in ("n", "blocked"))
        rate, size = (blocked + 1) / (n + 2), F.log1p(n)
        added = added.withColumns({f"{kind}_block_rate": rate, f"{kind}_log_count": size}).drop("__key", "__text", "n", "blocked", "folds")
    return added


def grow(training: DataFrame, boosting: Boosting) -> Trees:
    """The boosted trees of the rows (``__label``, ``FEATURES``)."""
    n, blocked, *cuts = training.agg(
        F.count("*"), F.sum("__label"),
        *[F.percentile_approx(f, [i / boosting.bins for i in range(1, boosting.bins)], 1000) for f in FEATURES],
    ).first()
    if not n:
        return Trees("-1D", {})
    if blocked in (0, n):
        return Trees("1D" if blocked else "-1D", {})
    thresholds = {f: sorted(set(c)) for f, c in zip(FEATURES, cuts, strict=True)}
    binned = training.select(
        "__label", *FEATURES,
        F.expr("array(" + ",".join("+".join(["0", *[f"IF({f} > {t!r}D, 1, 0)" for t in thresholds[f]]]) for f in FEATURES) + ")").alias("__bins"),
    )
    binned = written(binned, "bins")
    score = f"{math.log(blocked / (n - blocked))!r}D"
    gains: dict[str, float] = {}
    for tree in range(boosting.rounds):
        seen = {f: t for i, (f, t) in enumerate(thresholds.items()) if i % boosting.spared != tree % boosting.spared}
        score += " + " + _tree(binned, score, seen, boosting, gains)
    whole = sum(gains.values())
    return Trees(score, {f: g / whole for f, g in gains.items()})


def _tree(binned: DataFrame, score: str, thresholds: dict[str, list[float]], boosting: Boosting, gains: dict[str, float]) -> str:
    """One tree on the gradients of the logistic loss, a level of nodes per aggregation."""
    probability = f"(1 / (1 + exp(-({score}))))"
    rows = binned.withColumn("__p", F.expr(probability)).selectExpr(
        "*", "__label - __p AS __g", "__p * (1 - __p) AS __h"
    )
    splits: dict[int, tuple[str, float]] = {}
    leaves: dict[int, float] = {}
    for level in range(boosting.depth):
        sums = (
            rows.withColumn("__node", F.expr(_node(splits, level)))
            .filter(F.col("__node").isNotNull())
            .select("__node", "__g", "__h", F.posexplode("__bins").alias("__feature", "__bin"))
            .groupBy("__node", "__feature", "__bin")
            .agg(F.sum("__g").alias("g"), F.sum("__h").alias("h"))
            .collect()
        )
        found: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for node, feature, b, g, h in sums:
            found.setdefault(node, {}).setdefault(feature, {})[b] = (g, h)
        for node, by_feature in sorted(found.items()):
            _split(node, by_feature, splits, leaves, thresholds, boosting, gains)
    return _leaf_text(1, splits, leaves)


def _split(node, by_feature, splits, leaves, thresholds, boosting, gains) -> None:
    """Choose the best cut of a node; its two children become leaves until they are cut in turn."""
    some = next(iter(by_feature.values()))
    total_g, total_h = (sum(v[i] for v in some.values()) for i in (0, 1))

    def gain(g: float, h: float) -> float:
        return g * g / (h + boosting.smoothing)

    def value(g: float, h: float) -> float:
        return boosting.rate * g / (h + boosting.smoothing)

    best = (1e-6, "", 0.0, ())
    for feature, bins in sorted(by_feature.items()):
        name, g, h = FEATURES[feature], 0.0, 0.0
        for b, cut in enumerate(thresholds.get(name, [])):
            g, h = g + bins.get(b, (0, 0))[0], h + bins.get(b, (0, 0))[1]
            better = gain(g, h) + gain(total_g - g, total_h - h) - gain(total_g, total_h)
            if better > best[0]:
                best = (better, name, cut, (value(g, h), value(total_g - g, total_h - h)))
    leaves.setdefault(node, value(total_g, total_h))
    if best[1]:
        splits[node] = best[1], best[2]
        gains[best[1]] = gains.get(best[1], 0.0) + best[0]
        leaves[2 * node], leaves[2 * node + 1] = best[3]


def _node(splits: dict[int, tuple[str, float]], level: int) -> str:
    """SQL for the number of a row's node at ``level`` (root 1, children 2n and 2n + 1), null where the tree ended."""

    def at(node: int, depth: int) -> str:
        if depth == level:
            return str(node)
        if node not in splits:
            return "CAST(NULL AS INT)"
        name, cut = splits[node]
        return f"IF({name} > {cut!r}D, {at(2 * node + 1, depth + 1)}, {at(2 * node, depth + 1)})"

    return at(1, 0)


def _leaf_text(node: int, splits, leaves) -> str:
    if node not in splits:
        return f"{leaves.get(node, 0.0)!r}D"
    name, cut = splits[node]
    return f"IF({name} > {cut!r}D, {_leaf_text(2 * node + 1, splits, leaves)}, {_leaf_text(2 * node, splits, leaves)})"
