"""Brute-force versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

BLANK = re.compile("[\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in BLANK.split(lowered(text)) if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[lowered(t)].append(i)
    keep = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [(i, keep[lowered(t)], len(groups[lowered(t)]), i == keep[lowered(t)], sha(lowered(t))) for i, t in docs]


def near(docs):
    """(id, set size, component, kept); rows that share an id are one node, rows without id are alone."""
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    own = [(i, s) for (i, _), s in zip(docs, sets, strict=True) if i is not None and s]
    for k, (i, s) in enumerate(own):
        for j, u in own[:k]:
            n = len(s & u)
            if i == j or 100 * n >= 85 * (len(s) + len(u) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(i, len(s), find(i) if i is not None and s else i, (find(i) if i is not None and s else i) == i)
            for (i, _), s in zip(docs, sets, strict=True)]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 16 <= len(d) <= 19 and luhn(d)
                    or k == 3 and 8 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def secrets(text):
    out = []
    for k, (p, least, g) in enumerate(((r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
                                       ("AKIA[A-Z0-9]+", 16, 0), ("[0-9a-f]+", 32, 0))):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    return sorted(out)


def contaminated(docs, items):
    """(id, n_words, n_hit, item ids)"""
    def cut(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
    windows = defaultdict(set)
    for k, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add("" if k is None else str(k))
    out = []
    for i, t in docs:
        w, hit, got = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    got |= own
        out.append((i, len(w), len(hit), sorted(got)))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated resharing. sizes: source -> words."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        part = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if part[s] > most * sizes[s]]
        if not over:
            return full | part
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
