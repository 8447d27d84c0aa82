"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = words((text or "").translate(_LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=3):
    """Smallest index reachable per index."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def substrings(texts, size=35):
    """Words, words removed and digest of the words kept, per text."""
    found = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + size]) for w in found for i in range(len(w) - size + 1))
    out = []
    for w in found:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Target per source, by handing the excess over the ceilings on until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        now = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if now[s] >= most * sizes[s]]
        if not over:
            return {**now, **full}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def quality(text):
    w = words(text)
    text = text or ""
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i:i + 3])].append(i)
    repeated = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def licence_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def personal(text):
    """Base spans by the patterns as they are written."""
    text = text or ""
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    out = []
    for kind, pattern in rules:
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def bags(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def leaks(docs, items, least=0.8):
    """Pairs of document and item with a window of the item's size that is similar enough."""
    out = set()
    for d, text in docs:
        bag = bags(text)
        for i, item in items:
            want = Counter(bags(item))
            size = sum(want.values())
            if not size or not want.keys() & set(bag):
                continue
            for s in range(max(1, len(bag) - size + 1)):
                have = Counter(bag[s:s + size])
                shared = sum((want & have).values())
                if shared / (size + sum(have.values()) - shared) >= least:
                    out.add((d, i))
                    break
    return out
