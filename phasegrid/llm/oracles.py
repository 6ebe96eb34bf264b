"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from phasegrid.llm import chat, decontaminate, lexical, mixing, negatives, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_BENCHMARK_WORD}')"


def decontamination(window: int = decontaminate.WINDOW, coverage: int = decontaminate.COVERAGE) -> str:
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS words FROM documents),
  items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS words FROM benchmark),
  windows AS (SELECT DISTINCT coalesce(item, '') AS item, least({window}, len(words)) AS size,
      array_to_string(words[i:i + least({window}, len(words)) - 1], ' ') AS win
    FROM items, unnest(range(1, greatest(len(words) - {window - 1}, 1) + 1)) AS t(i) WHERE len(words) > 0),
  sizes AS (SELECT DISTINCT size FROM windows),
  found AS (SELECT r, i, size, item FROM (SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
      FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(i)) JOIN windows USING (win, size)),
  hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, size FROM found), unnest(range(i, i + size)) AS u(p) GROUP BY r),
  held AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {coverage} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)"""


def mix(seed: int = mixing.SEED, weights: tuple[int, ...] = mixing.WEIGHTS, most: int = mixing.MAX_EPOCHS) -> str:
    bits = mixing.STEP_BITS * mixing.STEPS
    shift = mixing.DRAW_HEX * 4 - bits
    common = 1
    for w in weights:
        common *= w
    return f"""WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {mixing.DRAW_HEX}) AS BIGINT) >> {shift} AS draw
    FROM documents),
  sources AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
    CAST({list(weights)}[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} + 1] AS HUGEINT) AS weight
    FROM docs GROUP BY source),
  ranked AS (SELECT *, {most} * source_size AS cap, {most} * source_size * ({common} // weight) AS ratio, sum(source_size) OVER () AS total FROM sources),
  levels AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY ratio GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM ranked),
  settled AS (SELECT *, weight * (total - below) > cap * above AS filled FROM levels),
  rest AS (SELECT *, total - coalesce(sum(cap) FILTER (filled) OVER (), 0) AS share, sum(weight) FILTER (NOT filled) OVER () AS free FROM settled),
  targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(share AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM rest),
  epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
  needs AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS need FROM epochs),
  runs AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY draw) AS total FROM (SELECT source, draw, sum(size) AS words FROM docs GROUP BY ALL)),
  met AS (SELECT needs.source, arg_min(draw + CASE WHEN words < 2 * (need - (total - words)) THEN 1 ELSE 0 END, draw) AS last
    FROM needs JOIN runs ON needs.source IS NOT DISTINCT FROM runs.source AND total >= need GROUP BY needs.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN draw < coalesce(last, {(1 << bits) - 1}) THEN 1 ELSE 0 END) AS taken
FROM docs JOIN needs ON docs.source IS NOT DISTINCT FROM needs.source LEFT JOIN met ON docs.source IS NOT DISTINCT FROM met.source"""


def secret_scans(rules: tuple[secrets.SecretRule, ...] = secrets.RULES, base: tuple[str, ...] = ("assign", "access", "hex")) -> str:
    found = " UNION ALL ".join(
        f"""SELECT r, '{rule.kind}' AS kind, {rank} AS rank, sizes[k] AS size, list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k - 1]), 0) AS begins
    FROM (SELECT r, [length(x) FOR x IN string_split_regex(text, '{pattern}')] AS gaps, [length(x) FOR x IN regexp_extract_all(text, '{pattern}')] AS sizes,
      [length(x) FOR x IN regexp_extract_all(text, '{pattern}', {rule.part})] AS parts FROM docs WHERE regexp_matches(text, '{pattern}')),
    unnest(range(1, len(sizes) + 1)) AS t(k) WHERE parts[k] >= {rule.least}"""
        for rank, rule in enumerate(rules)
        for pattern in [rule.pattern.replace("'", "''")]
    )
    span = "kind || ':' || begins || ':' || (begins + size)"
    own = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in base)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), found AS ({found})
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce(string_agg({span}, ',' ORDER BY begins, rank) FILTER (kind IN ({own})), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY begins, rank), '') AS spans
FROM docs LEFT JOIN found USING (r) GROUP BY r"""


def chat_formatting() -> str:
    pattern = chat.ESCAPABLE

    def size(text: str) -> str:
        return f"(length({text}) + len(regexp_extract_all({text}, '{pattern}')))"

    known = " ".join(f"WHEN '{r}' THEN {len(f.before) + len(f.after)}" for r, f in chat.FRAMES.items())
    spoken = f"coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{chat.SPOKEN}'), '')"
    return f"""WITH log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM log)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(length({spoken}) AS BIGINT) AS loss_chars, sha256({spoken}) AS loss_sha256,
  CAST(sum({size('text')} + CASE role {known} ELSE {len(chat.ROLE) + len(chat.TEXT) + len(chat.END)} + {size('role')} END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def hard_negatives(positives: int = negatives.POSITIVES, most: int = negatives.NEGATIVES) -> str:
    return f"""WITH vectors AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({negatives.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM vectors AS a, vectors AS b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
  positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= {positives}),
  numbered AS (SELECT *, row_number() OVER () AS p FROM positive)
SELECT n.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.p ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM numbered AS p JOIN scored AS n ON p.anchor = n.anchor AND NOT n.same AND {negatives.LEAST} * p.score <= 100 * n.score AND 100 * n.score <= {negatives.MOST} * p.score
QUALIFY rank <= {most}"""


def lexical_search(k: int = lexical.TOP) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{term}')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
  items AS (SELECT row_number() OVER () AS i, item_id, {words} AS words FROM benchmark),
  totals AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM docs),
  uses AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(words) AS term FROM items) GROUP BY ALL),
  postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM uses) GROUP BY ALL),
  weights AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
  scored AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM uses JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (r), totals GROUP BY i, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored JOIN docs USING (r) JOIN items USING (i) WHERE score > 0 QUALIFY rank <= {k}"""


ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontamination(),
    "op5_mixing": mix(),
    "op8_secret_scans": secret_scans(),
    "op11_chat_formatting": chat_formatting(),
    "op12_hard_negatives": hard_negatives(),
    "op13_lexical_search": lexical_search(),
}
