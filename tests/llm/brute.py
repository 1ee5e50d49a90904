"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

import xxhash


class Union:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    w = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(docs):
    """doc_id to (fingerprint, smallest doc_id of its component)."""
    f = {d: fingerprint(t) for d, t in docs.items()}
    u, ids = Union(f), sorted(f)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= 4:
                u.join(a, b)
    return {d: (f[d], u.find(d)) for d in f}


def line_keepers(docs):
    """(doc_id, line number) of every line in a component of several, to its first line."""
    rows = [(d, k, line) for d, t in sorted(docs.items()) for k, line in enumerate(t.split("\n")) if line.encode().strip()]
    lines = list(dict.fromkeys(line for _, _, line in rows))
    number = {line: i for i, line in enumerate(lines)}
    n = 5  # characters of a shingle
    sets = [{line[i : i + n] for i in range(max(1, len(line) - n + 1))} for line in lines]
    held, u = defaultdict(list), Union(range(len(lines)))
    for i, s in enumerate(sets):
        for j, common in Counter(j for g in s for j in held[g]).items():
            if common >= 0.8 * (len(s) + len(sets[j]) - common) - 1e-9:
                u.join(i, j)
        for g in s:
            held[g].append(i)
    groups = defaultdict(list)
    for d, k, line in rows:
        groups[u.find(number[line])].append((d, k))
    return {p: min(g) for g in groups.values() if len(g) > 1 for p in g}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def hits(docs, items):
    """doc_id to (words, places of hit words)."""
    windows = defaultdict(set)
    for text in items.values():
        w = plain_words(text)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[min(len(w), 13)].add(tuple(w[i : i + 13]))
    out = {}
    for d, t in docs.items():
        w = plain_words(t)
        out[d] = len(w), {i + k for size, found in windows.items() for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in found for k in range(size)}
    return out
