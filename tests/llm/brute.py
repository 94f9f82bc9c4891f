"""Brute-force versions in plain Python."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k=3):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(docs, percent=90, k=3):
    """docs: (id, text) rows with distinct ids -> {id: (size, component)}."""
    sets = {}
    for i, t in docs:
        sets.setdefault(shingle_set(t, k), []).append(i)
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    keys = [s for s in sets if s]
    for s in keys:
        for i in sets[s]:
            union(i, sets[s][0])
    index = {}
    for n, s in enumerate(keys):
        for g in s:
            index.setdefault(g, []).append(n)
    for n, s in enumerate(keys):
        seen = {}
        for g in s:
            for m in index[g]:
                if m > n:
                    seen[m] = seen.get(m, 0) + 1
        for m, inter in seen.items():
            if 100 * inter >= percent * (len(s) + len(keys[m]) - inter):
                union(sets[s][0], sets[keys[m]][0])
    return {i: (len(s), find(i)) for s, ids in sets.items() for i in ids}
