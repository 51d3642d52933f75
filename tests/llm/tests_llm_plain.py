"""Plain versions that operators are compared with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def linked(rows):
    """(n_shingles by row, component by row) by plain comparison of all sets."""
    sets = []
    for _, text, _ in rows:
        w = words((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [len(s) for s in sets], [least.get(root(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def without_copies(rows, least):
    """All runs of lines by plain comparison: a line goes if a run of enough words around it starts earlier too."""
    lines = [(t.split("\n") if t is not None else []) for _, t in rows]
    size = [[len(words(x)) for x in doc] for doc in lines]
    first = {}
    for d, doc in enumerate(lines):
        for a in range(len(doc)):
            for b in range(a, len(doc)):
                first.setdefault(tuple(doc[a : b + 1]), (d, a))
    out = []
    for d, doc in enumerate(lines):
        gone = set()
        for a in range(len(doc)):
            for b in range(a, len(doc)):
                if sum(size[d][a : b + 1]) >= least and first[tuple(doc[a : b + 1])] < (d, a):
                    gone |= set(range(a, b + 1))
        out.append((None if rows[d][1] is None else "\n".join(x for i, x in enumerate(doc) if i not in gone), len(gone)))
    return out
