"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def quality_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1
               for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def simhash(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fingerprints, radius=2):
    """Least id of the component for each (id, fingerprint)."""
    label = list(range(len(fingerprints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fingerprints)):
        for b in range(a):
            if (fingerprints[a][1] ^ fingerprints[b][1]).bit_count() <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(fingerprints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(fingerprints))]


def base_spans(text):
    text = text or ""
    assign = re.compile(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
        r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def deduplicated(rows):
    """(text, removed lines) of each (id, text); rows with equal ids share their windows."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    first, out = {}, [None] * len(rows)
    worded = {k: [p for p, x in enumerate((rows[k][1] or "").split("\n")) if WORD.search(x)]
              for k in order}
    gone_of = {}
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        gone = gone_of.setdefault(rows[k][0], set())
        for n in range(len(worded[k]) - 2):
            key = tuple(lines[worded[k][n + j]] for j in range(3))
            i, at = first.setdefault(key, (rows[k][0], n))
            if (i, at) != (rows[k][0], n):
                gone |= set(range(max(n, at + 3) if i == rows[k][0] else n, n + 3))
    for k in order:
        lines = (rows[k][1] or "").split("\n")
        gone = gone_of[rows[k][0]]
        drop = {worded[k][g] for g in gone if g < len(worded[k])}
        out[k] = (rows[k][1] if not gone else "\n".join(
            x for p, x in enumerate(lines) if p not in drop), len(gone))
    return out


def shingle_set(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def similar_components(docs, least=(4, 5)):
    """Smallest id of each component of the documents at or above the exact similarity."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if least[1] * both >= least[0] * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted(low.values())
