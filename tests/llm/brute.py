"""Plain versions of the training-data operators, for comparison on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def base_counts(text):
    w = words(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeated))


def repeats(w):
    """Longest repeat that begins at each word, by comparing all pairs of positions."""
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = FOLDED.findall((text or "").translate(UP))
        for i in range(max(1, len(w) - size + 1)) if w else []:
            windows[tuple(w[i:i + size])] |= {str(item)} - {"None"}
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w = FOLDED.findall((text or "").translate(UP))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                own = windows.get(tuple(w[i:i + m]))
                if own is not None:
                    hit.update(range(i, i + m))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def line_dedup(docs, least=20, documents=3):
    def key(line):
        return line.strip(BLANKS).translate(UP)
    order = (lambda i: (i is not None, i or 0))
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < documents
                or max(holders[key(x)], key=order) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text, width=5):
    w = words((text or "").translate(UP))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(docs, percent=75):
    """(doc_id, n, component, kept) with every pair compared that shares a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    up = {i: i for i in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), top(i), top(i) == i) for i in sorted(sets)]
