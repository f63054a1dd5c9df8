"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling as W


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain(words, times=5):
    near = {w: sorted((v for v in words if one_edit(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= times * words[w] else None for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def vocabulary(rng, alphabet, count, longest):
    return {"".join(rng.choices(alphabet, k=rng.randrange(2, longest))): 5 ** rng.randrange(0, 6) for _ in range(count)}


@pytest.mark.parametrize("alphabet, count, longest", [("ab", 120, 9), ("abcdé", 400, 8), ("abcdefghijkl", 300, 6)])
def test_variants(spark, alphabet, count, longest):
    words = vocabulary(random.Random(count), alphabet, count, longest)
    words |= {"x" * 3_000: 1, "x" * 3_001: 7, "prefix" + "a": 2, "prefix" + "b": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows(W.variants(df)) == plain(words)


def test_full_halves_and_empty(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 10)  # read where the plan is built: halves with more words are dealt to blocks
    words = {f"common{a}{b}": 1 + (a == b) * 9 for a in "abcdefgh" for b in "abcdefgh"}
    assert rows(W.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)
    none = spark.createDataFrame([], "word string, n long")
    assert W.variants(none).count() == 0 and W.near_pairs(none).count() == 0


def test_index():
    rng = random.Random(2)
    for _ in range(40):
        words = sorted(vocabulary(rng, rng.choice(["ab", "abcd", "abcdéz"]), rng.randrange(1, 90), 9))
        got = set()
        for turn, exact in ((lambda w: w[::-1], lambda w: len(w) // 2), (lambda w: w, lambda w: len(w) - len(w) // 2)):
            q, w = W.Index([turn(x) for x in words]).near([turn(x) for x in words], np.array([exact(x) for x in words]))
            found = list(zip(q.tolist(), w.tolist(), strict=True))
            assert len(found) == len(set(found))
            got |= {(words[a], words[b]) for a, b in found}
        assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_vocabulary(spark):
    docs = [(1, "Straße straße STRASSE Über-über"), (2, None), (None, "Words words wORDS"), (3, ""), (1, "Straße straße STRASSE Über-über"), (4, "x" * 70_000)]
    df = spark.createDataFrame([(*d, "a", "b") for d in docs], "doc_id long, text string, word string, n string").repartition(2)
    want = Counter()
    for _, t in docs:
        for w in "".join(c.lower() if c < "\x80" else c for c in t or "").replace("-", " ").split():
            want[w] += 1
    assert {r.word: r.n for r in W.vocabulary(df, least_length=1, least_count=1).collect()} == want
    slips = Counter()
    for i, t in docs:
        for w in "".join(c.lower() if c < "\x80" else c for c in t or "").replace("-", " ").split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            slips[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 2 == 0 else w] += 1
    assert {r.word: r.n for r in W.vocabulary(df, least_length=1, least_count=1, slip=2).collect()} == slips
    assert W.vocabulary(df.limit(0)).count() == 0
