"""Plain single-process versions of the operators, for small tables."""

import hashlib
import re
from itertools import combinations

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def substrings(docs, window):
    words = [(i, SPACE.findall(t or "")) for i, t in docs]
    first = {}
    for i, ws in words:
        for p in range(len(ws) - window + 1 if i is not None else 0):
            key = tuple(ws[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for p in range(len(ws) - window + 1 if i is not None else 0):
            if first[tuple(ws[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def secrets(text):
    text = text or ""
    found = [("assign", m) for m in re.finditer(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII)
        if len(m[2]) >= 6]
    found += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(((k, m.start(), m.end()) for k, m in found), key=lambda s: (s[1], order.index(s[0])))


def contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(upper))
    out = []
    for i, text in docs:
        ws, hit, found = split(text), set(), set()
        for item, item_text in items:
            iw = split(item_text)
            n = min(window, len(iw))
            for q in range(len(iw) - n + 1 if n and item is not None else 0):
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == iw[q : q + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return sorted(out, key=str)


def classes(docs, percent, n=3):
    """Classes over unique ids, each with its set size."""
    sets = {}
    for i, text in docs:
        ws = SPACE.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[i] = {tuple(ws[p : p + n]) for p in range(max(1, len(ws) - n + 1))} if ws else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), root(i)) for i, s in sets.items())
