"""Plain restatements of what the queries must return, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def contamination(docs, items, window=13):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        words = split.findall(lower(text or ""))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + window]), set()).add(str(item))
    result = []
    for text in docs:
        words = split.findall(lower(text or ""))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names:
                    found |= names
                    hit |= set(range(i, i + size))
        dirty = len(hit) > 0 and 20 * len(hit) >= len(words)
        result.append((len(words), len(hit), len(found), sha(",".join(sorted(found))), dirty))
    return result


def personal(text):
    text = text or ""

    def luhn(digits):
        total = 0
        for i, d in enumerate(map(int, reversed(digits))):
            d = d * 2 if i % 2 else d
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    spans = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return [sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone")], sha(",".join(spans)), spans


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source by redistributing until nothing is above its cap; exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(left * weight[s], sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, Fraction(most * sizes[s])) for s in order}
        full |= over


def simhash(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) if values else 0


def components(prints, distance=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def secrets(text):
    text = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    spans = []
    for rank, (kind, pattern, group, least) in enumerate((
        ("assign", rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    spans = [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]
    return [sum(s.startswith(k + ":") for s in spans) for k in ("assign", "access", "hex")], sha(",".join(spans)), spans


def repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    result = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        result.append((len(t), sum(gone), runs, sha(left)))
    return result


def hosts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return host, path, best


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def chat(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text) rows."""
    first = lambda v: (v is not None, v if v is not None else 0)
    of = {}
    for c, turn, role, text in rows:
        of.setdefault(c, []).append((first(turn), (role or "").encode(), (text or "").encode()))
    made = {}
    for c, turns in of.items():
        turns = sorted(turns)
        learnt = b"".join(t for _, r, t in turns if r == b"assistant")
        made[c] = (len(turns), sha(b"".join(r + b"\n" + t + b"\n" for _, r, t in turns)), len(learnt.decode()), sha(learnt))
    return made


def fold(log):
    """{(conv, message): (role, text)} by going through the events in order."""
    kinds = ["open", "delta", "edit", "regenerate"]
    key = lambda e: (e[1], kinds.index(e[3]), (e[4] is not None, e[4] or ""), e[5] or "")
    state = {}
    for conv, _, message, kind, role, text in sorted((e for e in log if e[3] in kinds), key=key):
        old = state.get((conv, message), (None, ""))
        if kind == "open":
            state[conv, message] = (role, text or "")
        elif kind == "delta":
            state[conv, message] = (old[0], old[1] + (text or ""))
        elif kind == "edit":
            state[conv, message] = (old[0], text or "")
        else:
            state = {k: v for k, v in state.items() if k[0] != conv or k[1] <= message}
            state[conv, message] = (old[0], "")
    return {k: (role or "", text) for k, (role, text) in state.items()}


def hard_negatives(rows):
    import math

    taken = [
        (v, (lab + 1) % 10 if v % 7 == 0 else lab, [math.floor(256 * x) for x in e])
        for v, e, lab in rows
        if v is not None and e is not None and lab is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    result = []
    for i, (anchor, label, vector) in enumerate(taken):
        if anchor % 100:
            continue
        scored = sorted((-score(vector, e), v, lab == label) for j, (v, lab, e) in enumerate(taken) if j != i)
        for p, positive, _ in [s for s in scored if s[2]][:5]:
            fit = [(-s, v) for s, v, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p][:10]
            result += [(anchor, positive, rank, v, -p, s) for rank, (s, v) in enumerate(fit, 1)]
    return result


def ranking(docs, items, top=10):
    import math

    split = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(d, Counter(split.findall(lower(t or "")))) for d, t in docs]
    total = sum(sum(c.values()) for _, c in terms)
    count = sum(bool(c) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    result = []
    for item, text in items:
        wanted = Counter(split.findall(lower(text or "")))
        scored = []
        for d, c in terms:
            m = 25 + (75 * sum(c.values()) * count) // max(1, total)
            s = sum(n * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        result += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored)[:top], 1)]
    return result
