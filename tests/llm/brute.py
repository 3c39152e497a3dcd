"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return SPACED.findall(text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminated(docs, items, width=10):
    wins = defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i:i + n])].add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i:i + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def base_rules(text):
    w, lines, seen, dup = spaced(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if spaced(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def without_repeats(docs, window=20):
    """docs: (doc_id, text), one text per id."""
    first = {}
    rank = lambda d: -1 if d is None else d
    for doc, text in sorted(set(docs), key=lambda x: rank(x[0])):
        w = spaced(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (rank(doc), i))
    out = []
    for doc, text in docs:
        w, gone = spaced(text), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (rank(doc), i):
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def grams(text, n):
    w = spaced((text or "").translate(LOW))
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_groups(docs, n, percent):
    sets = {i: grams(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i in ids:
        least.setdefault(root(i), i)
    return {i: (len(sets[i]), least[root(i)]) for i in ids}
