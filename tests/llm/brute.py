"""Plain-Python answers that the operators must give."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def repeats(rows, size=50):
    first: dict = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    words = (text or "").encode().translate(_LOWER).split()
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_duplicates(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for e in s:
            holders[e].append(i)
    pairs = {p for ids in holders.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def figures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {j for w in at.values() if len(w) > 1 for i in w for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed
