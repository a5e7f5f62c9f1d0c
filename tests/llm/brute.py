"""Plain Python versions of the operators' rules, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
BENCHMARK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spans(flags) -> int:
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def cover(starts, length, size):
    flags = [False] * size
    for s in starts:
        for i in range(s, s + length):
            flags[i] = True
    return flags


def line_dedup(rows, n, passage=50):
    """rows: (id, text) in the order of the table's rule; for each: kept text, lines, removed, runs.
    A line of ``passage`` words or more is a run by itself."""
    lines, firsts = [], {}
    for r, (_, text) in enumerate(rows):
        own = [(i, line.strip(" \t\n\x0b\x0c\r")) for i, line in enumerate((text or "").split("\n"))]
        own = [(i, s) for i, s in own if s]
        lines.append(own)
        for p in range(len(own) - n + 1):
            firsts.setdefault(tuple(s for _, s in own[p:p + n]), (r, p))
        for p, (_, line) in enumerate(own):
            firsts.setdefault(line, (r, p))
    out = []
    for r, (_, text) in enumerate(rows):
        own = lines[r]
        late = [p for p in range(len(own) - n + 1) if firsts[tuple(s for _, s in own[p:p + n])] != (r, p)]
        gone = cover(late, n, len(own))
        gone = [g or (len(BLANK.findall(s)) >= passage and firsts[s] != (r, p)) for p, (g, (_, s)) in enumerate(zip(gone, own))]
        drop = {i for (i, _), g in zip(own, gone) if g}
        kept = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
        out.append((kept, len(own), sum(gone), spans(gone)))
    return out


def shingles(text, n):
    w = BLANK.findall(lower(text))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, words, percent):
    """rows: (id, text), ids unique; id -> smallest id of its component."""
    sets = {k: shingles(t, words) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def wrapped(x):
    """An integer as a long holds it."""
    return (int(x) + 2 ** 63) % 2 ** 64 - 2 ** 63


def top_k(rows, asks, k=10, scale=1024):
    """rows: (id, vector), ids unique."""
    good = {i: np.floor(scale * np.array(v, dtype=float)).astype(object) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(v) for v in good.values()), default=0)
    good = {i: [wrapped(x) for x in v] + [0] * (width - len(v)) for i, v in good.items()}
    out = []
    for q in good:
        if asks(q):
            best = sorted((-wrapped(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def drop_repeats(rows, length):
    """rows: (id, text); per row: words, removed, kept."""
    words = [BLANK.findall(t or "") for _, t in rows]
    times = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = cover([i for i in range(len(w) - length + 1) if times[tuple(w[i:i + length])] > 1], length, len(w))
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def drop_later_copies(rows, length):
    """rows: (id, text), a null id being the largest; per row: bytes, removed, spans, kept."""
    order = lambda k: float("inf") if k is None else k
    least = {}
    for k, t in sorted(rows, key=lambda r: order(r[0])):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            least.setdefault(b[i:i + length], order(k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = cover([i for i in range(len(b) - length + 1) if least[b[i:i + length]] < order(k)], length, len(b))
        out.append((len(b), sum(gone), spans(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def leaks(rows, items, length=10):
    """rows: (id, text); per row: words, hits, sorted ids of items."""
    windows = defaultdict(set)
    for i, t in items:
        w = BENCHMARK.findall(lower(t))
        if i is not None and w:
            for j in range(max(1, len(w) - length + 1)):
                windows[tuple(w[j:j + length])].add(i)
    out = []
    for _, t in rows:
        w = BENCHMARK.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j:j + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out
