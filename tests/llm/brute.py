"""Plain versions of the operators' definitions."""

import re
from collections import defaultdict

import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower(text):
    return (text or "").encode().translate(LOWER)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows):
    """Least id reachable over links of 0.75 or more, by id; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(n)
    for n, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for m in where[x]:
                if m < n:
                    common[m] += 1
        for m, c in common.items():
            j, other = sets[m]
            if 100 * c >= 75 * (len(s) + len(other) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in sets}


def removed(rows, length=100):
    """Each text and which of its bytes go; documents in order of id, then of the hash of their text."""
    bodies = [(t or "").encode() for _, t in rows]
    keys = [None if i is None else (i, ((xxhash.xxh64(b, 42).intdigest() + 2**63) % 2**64) - 2**63) for (i, _), b in zip(rows, bodies)]
    first = {}
    for key, body in zip(keys, bodies):
        for k in range(len(body) - length + 1 if key else 0):
            if first.setdefault(body[k: k + length], (key, k)) > (key, k):
                first[body[k: k + length]] = (key, k)
    out = []
    for key, body in zip(keys, bodies):
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1 if key else 0):
            if first[body[k: k + length]] < (key, k):
                gone[k: k + length] = b"\1" * length
        out.append((body, gone))
    return out
