"""The corpus operators said plainly, for small inputs."""

import hashlib
import re
from collections import defaultdict

SPACED, WORD = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def spaced(text, fold=False):
    return SPACED.findall((text or "").translate(FOLD) if fold else text or "")


def plain(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, k=5):
    w = spaced(text, True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k=5, percent=75):
    """docs: (doc_id, text). doc_id to number of shingles and smallest doc_id reachable."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    up = {d: d for d, _ in docs if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            n = len(s & t)
            if s and t and a is not None and b is not None and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


def without_repeats(docs, window=50):
    """(doc_id, words, words that stay) of each row."""
    first = {}
    for d, t in docs:
        w = spaced(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        w = spaced(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def digest(docs, window=50):
    return sorted(((d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, w, k in without_repeats(docs, window)), key=str)


def hits(docs, items, n=10):
    """(doc_id, n_words, n_hit, sorted items) of each row."""
    grams = defaultdict(set)
    for item, t in items:
        w = plain(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[i : i + k])].add(item)
    out = []
    for d, t in docs:
        w, hit, found = plain(t), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[g] - {None}
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def targets(sizes, weights=(3, 1, 2), percent=150, cap=2):
    """source to target, by sharing out the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = percent / 100 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s] + 1e-9}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out
