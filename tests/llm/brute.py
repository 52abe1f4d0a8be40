"""Plain forms of the operators, over Python lists, for small inputs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def components(nodes, links) -> dict:
    """Smallest node in reach of each."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        stack = [n] if n not in out else []
        while stack:
            m = stack.pop()
            if m not in out:
                out[m] = n
                stack.extend(near[m])
    return out


def katz(texts: list[tuple[bool, str | None]], reserve: float, k: int, discounts):
    """(n_tokens, n_known, train_tokens, base_score, score) of each text, and the model P(w | h)."""
    tokens = [words(t) + [None] for _, t in texts]
    single, pair = Counter(), defaultdict(Counter)
    for (learned, _), ts in zip(texts, tokens):
        if learned:
            single.update(ts)
            for h, w in zip([b" start"] + ts, ts):
                pair[h][w] += 1
    total, distinct = sum(single.values()), len(single)
    times = Counter(c for f in pair.values() for c in f.values())
    d = discounts([times[r] for r in range(k + 2)])

    def p(w):
        return (single[w] + 0.5) / (total + 0.5 * (distinct + 1))

    def given(w, h):
        after = pair.get(h)
        if not after:
            return p(w)
        n = sum(after.values())
        if w in after:
            return (d[after[w]] if after[w] <= k else 1) * after[w] / (n + reserve)
        left = 1 - sum((d[c] if c <= k else 1) * c / (n + reserve) for c in after.values())
        return left / (1 - sum(p(x) for x in after)) * p(w)

    rows = [(len(ts), sum(single[t] > 0 for t in ts), total, sum(math.log10(p(t)) for t in ts),
             sum(math.log10(given(w, h)) for h, w in zip([b" start"] + ts, ts))) for ts in tokens]
    return rows, given, list(single), pair
