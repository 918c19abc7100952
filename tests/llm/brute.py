"""Plain re-implementations of the contracts, for small inputs."""

import hashlib
import re
from array import array

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def jaccard_components(rows, k, num, den):
    """{doc_id: (n_shingles, component)}"""
    sets = {}
    for i, text in rows:
        w = SPACE_WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    by = {}
    for i in ids:
        for t in sets[i]:
            by.setdefault(t, []).append(i)
    for n, a in enumerate(ids):
        seen = {}
        for t in sets[a]:
            for b in by[t]:
                if b > a:
                    seen[b] = seen.get(b, 0) + 1
        for b, both in seen.items():
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(rows, items, window):
    found = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        for j in range(max(0, len(w) - window) + 1 if w else 0):
            found.setdefault(tuple(w[j : j + window]), set()).add(item)
    sizes = {len(x) for x in found}
    out = {}
    for i, text in rows:
        w = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (got := found.get(tuple(w[j : j + size]))) is not None:
                    hit |= set(range(j, j + size))
                    ids |= got
        out[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit))
    return out


def substring(rows, window):
    docs = [(i, SPACE_WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for j in range(len(w) - window + 1):
                key = tuple(w[j : j + window])
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in docs:
        gone = set()
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def packed(ids):
    return array("I", ids).tobytes()
