"""Plain Python versions of the text operators, for small tables."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

SPACE = b" \t\n\r\x0b\x0c"


def words(text):
    return text.encode().split() if text else []


def shingles(text, width=5):
    w = [x.lower() for x in words(text)]
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups(n, linked):
    """Group number (smallest member) of 0..n-1 under the linked index pairs."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def jaccard(rows, percent=80):
    """Per row (doc_id, text): set size and smallest doc_id of its component (null last)."""
    sets = [shingles(t) for _, t in rows]
    posted = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posted[x].append(i)
    pairs = {(a, b) for ids in posted.values() for k, b in enumerate(ids) for a in ids[:k]}
    linked = []
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            linked.append((a, b))
    group = groups(len(rows), linked)
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, len(s), least.get(g)) for (doc, _), s, g in zip(rows, sets, group, strict=True)]


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = set()
    for i in range(len(w) - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(inside))


def kneser_ney(texts, order):
    """Probability function p(byte sequence) of an interpolated modified Kneser-Ney model over bytes."""
    counts = {order: Counter()}
    for t in texts:
        data = b"\n" * (order - 1) + t + b"\n"
        for i in range(len(data) - order + 1):
            counts[order][data[i : i + order]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    weight = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in range(1, 5))
        d = (0.5, 1.0, 1.5)
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            d = tuple(min(max(x, 0.05), k) for x, k in zip(d, (1, 2, 3), strict=True))
        total, lost = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            lost[g[:-1]] += d[min(v, 3) - 1]
        weight[n] = (d, total, lost)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        d, total, lost = weight[n]
        context = g[:-1]
        if context not in total:
            return p(g[1:])
        v = counts[n].get(g, 0)
        own = (v - d[min(v, 3) - 1]) / total[context] if v else 0.0
        return own + lost[context] / total[context] * p(g[1:])

    return p


def bits(p, text, order):
    data = b"\n" * (order - 1) + text + b"\n"
    return sum(-math.log2(p(data[i : i + order])) for i in range(len(data) - order + 1))


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source: excess above the cap shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return held | share
        held |= {s: most * sizes[s] for s in above}
