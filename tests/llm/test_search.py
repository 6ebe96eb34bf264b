"""Chat logs, hard negatives and the lexical index against plain versions of their parts."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phasegrid.llm import chat, lexical, negatives, pii, toxicity
from phasegrid.llm.queries import tokenizer_path
from phasegrid.llm.tokens import WordEncoder

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def said(df):
    return {(r.conv_id, r.message): (r.role, r.text) for r in df.collect()}


def test_streams_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "open", "user", "Hi"), (1, 1, 1, "open", "assistant", ""), (1, 2, 1, "delta", None, "Go "), (1, 3, 1, "delta", None, "away"),
        (1, 4, 2, "open", "user", "Rude!"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "Hel"), (1, 7, 1, "delta", None, "lo"),
        (1, 8, 2, "open", "user", "Thanks"), (1, 9, 0, "edit", None, "Hi there"), (1, 10, 0, "delta", None, "!"), (1, 11, 2, "whatever", None, "no"),
        (2, 0, 5, "delta", None, "never opened"),
    ]
    found = said(chat.final_messages(spark.createDataFrame(log, LOG)))
    assert found == {(1, 0): ("user", "Hi there!"), (1, 1): ("assistant", "Hello"), (1, 2): ("user", "Thanks"), (2, 5): ("", "never opened")}
    assert found == brute.fold(log)


def test_random_logs(spark):
    rng = random.Random(8)
    kinds = ["open", "delta", "delta", "delta", "edit", "regenerate", "other"]
    log = [
        (c, rng.choice([s, s, 3]), rng.randrange(5), rng.choice(kinds), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "cc"]))
        for c in range(200) for s in range(rng.randint(0, 25))
    ]
    assert said(chat.final_messages(spark.createDataFrame(log, LOG).repartition(5))) == brute.fold(log)


def test_texts_of_control_strings_are_read_back(spark):
    rng = random.Random(9)
    bits = [*chat.MARKS, "\\", "<", "[", "/", "s>", "INST]", " ", "x", "é😀", "\n", "$1"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(600)]
    log = [(i // 6, i, i % 6, "open", rng.choice(["user", "assistant", texts[i - 1]]), t) for i, t in enumerate(texts)]
    formatted = chat.format_conversations(spark.createDataFrame(log, LOG))
    back = {(r.conv_id, r.place): (r.role, r.text, r.learnt) for r in chat.read_back(formatted).collect()}
    assert back == {(c, m): (role, t, role == "assistant") for c, _, m, _, role, t in log}
    for row in formatted.collect():
        marks = sum(row.formatted.count(m) for m in ("[/INST]", "</s>", "[/TEXT]"))
        assert marks == row.n_messages == 6
        assert all(row.formatted[s.end :].startswith("</s>") for s in row.loss)


def some_vectors(rng, n, dim, spread):
    centre = np.random.default_rng(1).normal(size=(4, dim))
    return np.floor(256 * (centre[rng.integers(4, size=n)] + spread * rng.normal(size=(n, dim)))).astype(np.int64)


LOW, HIGH = 300_000, 450_000


def group_of(vectors, labels, asked, same, k):
    n = len(vectors)
    packed = negatives._packed(np.arange(n), np.arange(n) * 10, labels, vectors)
    return negatives._Group({**{f"g_{c}": v[0] for c, v in packed.items()}, "g_asked": np.array(asked, np.int64).tobytes()}, same, k)


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0])
def test_walks_find_the_best_and_stop(monkeypatch, spread):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rng = np.random.default_rng(4)
    members = some_vectors(rng, 1, 8, 0)[[0] * 5] + rng.integers(-9, 9, size=(5, 8))
    group = group_of(members, np.arange(5) % 2, [[(-(1 << 62), 1 << 62, 0, 0), (LOW, HIGH, 1, 1)]] * 5, True, 4)
    candidates = some_vectors(rng, 2000, 8, spread)
    labels = rng.integers(2, size=2000)
    scored = 0
    for part in np.array_split(np.arange(2000), 3):
        scored += negatives.walk(group, part + 100, part, labels[part], candidates[part])
    for m in range(5):
        scores = candidates @ members[m]
        for w, (low, high) in enumerate([(-(1 << 62), 1 << 62), (LOW, HIGH)]):
            fit = sorted((-s, i) for i, s in enumerate(scores.tolist()) if labels[i] == m % 2 and low <= s <= high)[:4]
            got = [(-s, i) for s, i in zip(group.scores[m, w].tolist(), group.found[m, w].tolist(), strict=True) if s != negatives._NONE]
            assert got == fit
    if spread == 0.05:
        assert scored < 5 * 2000 / 2


def test_numbers_too_large_for_floats():
    members = np.array([[1 << 30, 1], [1 << 29, 3]])
    candidates = np.array([[1 << 30, 0], [1 << 30, 1], [(1 << 30) - 1, 5]])
    group = group_of(members, np.zeros(2, int), [[(-(1 << 62), 1 << 62, 0, 0)]] * 2, True, 3)
    negatives.walk(group, np.array([7, 8, 9]), np.array([7, 8, 9]), np.zeros(3, int), candidates)
    exact = [sorted(((int(m[0]) * int(c[0]) + int(m[1]) * int(c[1])) for c in candidates), reverse=True) for m in members]
    assert group.scores[:, 0].tolist() == exact


texts = st.lists(st.lists(st.sampled_from(["the", "of", "rare", "é", "zz", "q1"]), max_size=30).map(" ".join), min_size=1, max_size=40)


@settings(max_examples=40, deadline=None)
@given(texts)
def test_index_blocks(docs):
    block, lexical.BLOCK = lexical.BLOCK, 4
    try:
        terms, df, fronts, lists, sizes = lexical.invert(pa.array([d.encode() for d in docs], pa.large_binary()))
    finally:
        lexical.BLOCK = block
    assert sizes.tolist() == [len(d.split()) for d in docs]
    shard = lexical.Shard(sizes, 50, 700)
    for term, n, front, data in zip(terms.to_pylist(), df.tolist(), fronts.to_pylist(), lists.to_pylist(), strict=True):
        p = lexical.Postings(data)
        found = [(d, f) for b in range(len(p.last)) for d, f in zip(*(x.tolist() for x in p.block(b)), strict=True)]
        assert found == [(i, d.split().count(term)) for i, d in enumerate(docs) if term in d.split()] and len(found) == n
        share = [lexical.shares(p.block(b)[1], sizes[p.block(b)[0]], 50, 700).max() for b in range(len(p.last))]
        assert shard.block_maxima(p).tolist() == share
        best = np.array([(f["tf"], f["n"]) for f in front])
        assert lexical.shares(best[:, 0], best[:, 1], 50, 700).max() == max(share)


def test_blocks_are_rejected_before_they_are_decoded(monkeypatch):
    monkeypatch.setattr(lexical, "RANGE", 64)
    rng = random.Random(2)
    docs = [" ".join(["the"] * rng.randint(1, 3) + (["rare"] * 5 if i % 97 == 3 else []) + ["pad"] * rng.randint(0, 60)) for i in range(4000)]
    terms, df, fronts, lists, sizes = lexical.invert(pa.array([d.encode() for d in docs], pa.large_binary()))
    total = int(sizes.sum())
    found = []
    for limit in (0, 1):
        shard = lexical.Shard(sizes, 4000, total)
        uses = []
        for term, n, front, data in zip(terms.to_pylist(), df.tolist(), fronts.to_pylist(), lists.to_pylist(), strict=True):
            if term != "pad":
                w = int(1000 * np.log(8002 / (2 * n + 1)))
                best = np.array([(f["tf"], f["n"]) for f in front])
                uses.append((lexical.Postings(data), w, w * int(lexical.shares(best[:, 0], best[:, 1], 4000, total).max())))
        q = lexical._Query(uses, 0, 10)
        shard.search(q)
        found.append(sorted(zip((-q.scores).tolist(), q.docs.tolist(), strict=True))[:10])
        wanted = brute.ranking(list(enumerate(docs)), [(1, "the rare")])
        assert [(d, -s) for s, d in found[-1]] == [(d, s) for _, _, d, s in wanted]
        assert shard.opened < 0.7 * sum(len(p.last) for p, _, _ in uses) and limit in (0, 1)


def test_words_of_any_kind_are_encoded_together():
    words = ["don't", "e\u0301", "é", "1234.56!?", "naïve-word", "<|endoftext|>", "ﬁ½", "'s", "x", "ΣΊΣΥΦΟΣ", "İ", "\u0301", "a1b2", "--'re", "日本語x"] * 40
    encoder = WordEncoder(tokenizer_path())
    encoder._learn([w.encode() for w in words])
    plain = encoder._encode(words)
    assert [np.frombuffer(encoder.known[w.encode()], encoder.type).tolist() for w in words] == plain


def test_many_spans_in_one_text_take_linear_memory():
    found = {("email", 10 * i, 10 * i + 9): 0.9 for i in range(50_000)} | {("phone", 10 * i + 5, 10 * i + 12): 0.5 for i in range(50_000)}
    chosen = pii._reconciled(found)
    assert len(chosen) == 50_000 and all(kind == "email" for kind, *_ in chosen)


def test_long_labelled_texts_take_part(spark):
    """A class that has only long texts is learnt, from the part of each that its marked words stand in."""
    rng = random.Random(1)
    plain = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) for _ in range(n))
    rows = [(1, plain(4000) + " vile vile scum " + plain(3000)) for _ in range(40)] + [(0, plain(6000)) for _ in range(40)]
    field = toxicity.fit(spark.createDataFrame(rows, "toxic int, text string"))
    assert isinstance(field, toxicity.Field)
    texts = [(1, "you vile scum"), (2, plain(30)), (3, "é 😀 " + plain(9000) + " vile scum")]
    scored = {r.id: r for r in toxicity.score_texts(spark.createDataFrame(texts, "id int, text string"), field).collect()}
    assert scored[2].score < 0.5 < min(scored[1].score, scored[3].score)
    spans = [texts[2][1][s.start : s.end] for s in scored[3].toxic_spans]
    assert spans == ["vile scum"]
