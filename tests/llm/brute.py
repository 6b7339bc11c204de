"""Plain versions of the ten contracts, written without any of the operators' code."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def neardup(docs, k=3, num=85, den=100, fold=lower):
    """docs: [(id, text)] -> {id: (n, component)}; for distinct ids."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(fold(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    shared = Counter()
    for ids in by.values():
        ids = sorted(ids)
        for a, x in enumerate(ids):
            for y in ids[a + 1 :]:
                shared[x, y] += 1
    for (x, y), n in shared.items():
        if den * n >= num * (len(sets[x]) + len(sets[y]) - n):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def base_scores(docs):
    train = Counter()
    rows = []
    for i, t in docs:
        w = WORD.findall(lower(t)) + [None]
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        rows.append((i, held, w))
        if not held:
            train.update(w)
    n, v = sum(train.values()), len(train)
    return [(i, held, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, held, w in rows]


def lm_scores(docs, discount=0.75):
    """{id: log10 probability} by an interpolated trigram model with absolute discounts, written out; for distinct ids."""
    texts = [(i, [*WORD.findall(lower(t)), None]) for i, t in docs]
    count, follow = Counter(), defaultdict(set)
    for i, w in texts:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            for k in (1, 2, 3):
                for j in range(len(w) - k + 1):
                    g = tuple(w[j : j + k])
                    count[g] += 1
                    follow[g[:-1]].add(g[-1])
    words = [c for g, c in count.items() if len(g) == 1]
    n, v, once, twice = sum(words), len(words), words.count(1), words.count(2)
    d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else discount

    def p(g):
        if len(g) == 1:
            return 1.0 if not n else (count[g] - d) / n if count[g] else d * v / n
        head = count[g[:-1]]
        return p(g[1:]) if not head else (max(count[g] - discount, 0) + discount * len(follow[g[:-1]]) * p(g[1:])) / head

    return {i: sum(math.log10(p(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w))) for i, w in texts}


def topk(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(set(out))


def substring(docs, window=20):
    """[(id, text)] with distinct ids -> {id: (n_words, n_removed, sha)}."""
    first, words = {}, {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [("assign", ASSIGN), ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    found = []
    for o, (kind, rx) in enumerate(KINDS):
        for m in rx.finditer(text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24):
                found.append((m.start(), o, m.end()))
    spans = ",".join(f"{KINDS[o][0]}:{a}:{b}" for a, o, b in sorted(found))
    return (*[sum(o == k for _, o, _ in found) for k in range(3)], hashlib.sha256(spans.encode()).hexdigest())


MORE = [
    ("forge", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
]
#: Lines of a private key, read one by one.
BEGIN = re.compile(r"-----BEGIN (?:[A-Z]+ )*?PRIVATE KEY-----")


def all_spans(text):
    """Every span, base kinds and the method's own; for texts whose private keys have a BEGIN line alone."""
    text, found = text or "", []
    for o, (kind, rx) in enumerate([*KINDS, ("pem", BEGIN), *MORE]):
        for m in rx.finditer(text):
            least = {"assign": 6, "access": 20, "hex": 24}.get(kind, 0)
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), o, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
