"""Suffix-array deduplication and its external sort against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import induced as I
from plumbline.llm import suffix_dedup as D

SCHEMA = "doc_id long, text string, spans string, b1 string, key string, body string, _row string, maybe string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in docs], SCHEMA).repartition(3)


def removed(docs):
    """(id, bytes, removed, spans, sha of the rest) by counting every string of 200 bytes."""
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(x[i : i + 200] for x in texts for i in range(len(x) - 199))
    out = []
    for (i, _), x in zip(docs, texts, strict=True):
        gone = np.zeros(len(x) + 2, bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = True
        left = bytes(b for b, g in zip(x, gone[1:], strict=False) if not g)
        out.append((i, len(x), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choices("abcdefgh éß𝒳", k=n))
    passages = [prose(n) for n in (90, 150, 260, 700, 2_000)]
    out = [(0, None), (1, ""), (2, "short"), (3, "short"), (4, "x" * 199), (5, "x" * 199), (6, "y" * 200), (7, "z" * 201), (8, "ab" * 3_000), (9, "q" * 50_000)]
    for k in range(20, 90):
        t = prose(rng.randrange(0, 900))
        for _ in range(k % 3):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(passages) + t[at:]
        out.append((k, t))
    out += [(200 + k, passages[3]) for k in range(30)] + [(300 + k, f"{k} " + passages[2] + f" {k * k}") for k in range(30)]
    cycle = prose(9)
    return [*out, (None, passages[1] + "tail"), out[20], (25, out[21][1]), (400, cycle * 30)]


def rows(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_repeats(spark, docs):
    want = sorted(removed(docs), key=str)
    assert any(w[2] for w in want) and any(not w[2] for w in want)
    assert rows(D.repeats(frame(spark, docs))) == want


def test_refined_and_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "HOT_ROWS", 2)
    monkeypatch.setattr(D, "HOT_SHARE", 50)
    assert rows(D.repeats(frame(spark, docs))) == sorted(removed(docs), key=str)
    texts = [(t or "").encode() for _, t in docs]
    plain = D.segments(texts)
    keys, many = np.unique(plain[3], return_counts=True)
    again = D.segments(texts, np.sort(keys[many > 1]))
    assert again[4].any()
    for text, start, end, key, *_ in (plain, again):
        known, cover = {}, Counter()
        for q, a, z, k in zip(text.tolist(), start.tolist(), end.tolist(), key.tolist(), strict=True):
            for i in range(a, z - 199):
                cover[q, i] += 1
                assert known.setdefault(texts[q][i : i + 200], k) == k  # equal strings, equal shards
        assert set(cover.values()) == {1} and len(cover) == sum(max(0, len(x) - 199) for x in texts)


def test_without_repeats(spark, docs):
    df = frame(spark, docs)
    out = D.without_repeats(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, len((r.text or "").encode())) for r in out.collect())
    assert sum(got.values()) == len(docs)
    for i, n, m, _, _ in removed(docs):
        assert any(k == i and size <= n - m and size >= n - m - 20 for k, size in got)  # halves of code points go too


def test_empty(spark):
    assert D.repeats(frame(spark, [])).count() == 0 and D.without_repeats(frame(spark, [])).count() == 0
    assert rows(D.repeats(frame(spark, [(1, None), (None, "")]))) == sorted(removed([(1, None), (None, "")]), key=str)


def test_sorted_suffixes(monkeypatch):
    rng = random.Random(7)
    for turn in range(160):
        if turn >= 80:  # blocks, files and single entries
            monkeypatch.setattr(I, "STEP", 7)
            monkeypatch.setattr(I, "ROOM", 16)
            monkeypatch.setattr(I, "FEW", rng.choice((0, 2, 64)))
        t = bytes(rng.choices(rng.choice((b"a", b"ab", b"abc", bytes(range(256)))), k=rng.choice((1, 2, 9, 60, 300))))
        t *= rng.choice((1, 1, 4))
        order, common = I.sort(np.frombuffer(t, np.uint8), 256, True)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want
        for a, b, c in zip(want, want[1:], common[1:].tolist(), strict=False):
            n = next((k for k in range(min(200, len(t) - max(a, b))) if t[a + k] != t[b + k]), min(200, len(t) - max(a, b)))
            assert c == n
    assert len(I.sort(np.zeros(0, np.uint8), 256)[0]) == 0
