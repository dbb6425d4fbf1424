"""Plain re-statements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def crc(k):
    return zlib.crc32(str(k).encode())


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    three = Counter(zip(w, w[1:], w[2:]))
    hit = {p for k, g in enumerate(zip(w, w[1:], w[2:])) if three[g] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def _either(word):
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


SECRETS = [
    ("assign", "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def digits(m):
    return re.sub("[^0-9]", "", m[0])


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def spans(text, kinds):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fingerprint(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    """Smallest index reachable, by pairwise comparison."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def unigram(rows):
    """{id: (held_out, n_tokens, n_known, N, base_score)}"""
    tokens = {k: [*WORD.findall(lower(t or "")), None] for k, t in rows}
    c = Counter(w for k, ws in tokens.items() if crc(k) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return {k: (crc(k) % 7 == 2, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for k, ws in tokens.items()}


def targets(sizes):
    """Shares of 150 % by weight with caps, resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
    return out


def merged(word, rank, skip):
    """Best-ranked pair first, leftmost of equals; a skipped pair waits until one
    of its sides changes."""
    part, edge, struck = list(word), list(range(len(word) + 1)), set()
    while True:
        open_ = [(rank[part[i] + part[i + 1]], i) for i in range(len(part) - 1) if part[i] + part[i + 1] in rank and (edge[i], edge[i + 1], edge[i + 2]) not in struck]
        if not open_:
            return part
        _, i = min(open_)
        if skip(edge[i], edge[i + 2]):
            struck.add((edge[i], edge[i + 1], edge[i + 2]))
            continue
        part[i : i + 2] = [part[i] + part[i + 1]]
        del edge[i + 1]


def suffix_tree(rows, depth, least, divergence):
    """{id: log10 probability} and the number of kept contexts, by dictionaries."""
    texts = {k: ["\r", *WORD.findall(lower(t or "")), "\n"] for k, t in rows}
    train = {k for k in texts if crc(k) % 7 != 2}
    c = Counter(w for k in train for w in texts[k][1:])
    total, distinct = sum(c.values()), len(c)
    p = {k: [None] + [math.log((c[w] + 1) / (total + distinct + 1)) for w in ws[1:]] for k, ws in texts.items()}
    sure, kept_contexts = {k: [False] * len(ws) for k, ws in texts.items()}, 0
    for d in range(1, depth + 1):
        n, grams = Counter(), Counter()
        for k in train:
            for i in range(d, len(texts[k])):
                context = tuple(texts[k][i - d : i])
                n[context] += 1
                grams[context, texts[k][i]] += 1
        saved = Counter()
        for k in train:
            for i in range(d, len(texts[k])):
                context = tuple(texts[k][i - d : i])
                if n[context] >= least and not sure[k][i]:
                    q, spare = p[k][i], math.sqrt(n[context])
                    saved[context] += math.log((grams[context, texts[k][i]] - 1 + spare * math.exp(q)) / (n[context] - 1 + spare)) - q
        kept = {x for x, s in saved.items() if s >= divergence}
        kept_contexts += len(kept)
        for k, ws in texts.items():
            for i in range(d, len(ws)):
                context = tuple(ws[i - d : i])
                if n[context] < least:
                    continue
                g = grams[context, ws[i]]
                if context in kept and not sure[k][i]:
                    spare = math.sqrt(n[context])
                    p[k][i] = math.log((g + spare * math.exp(p[k][i])) / (n[context] + spare))
                sure[k][i] = sure[k][i] or g == n[context]
    return {k: sum(x[1:]) / math.log(10) for k, x in p.items()}, kept_contexts
