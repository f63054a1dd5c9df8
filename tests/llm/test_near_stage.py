"""The pipeline's near-copy stage against brute force in shingles of five words, a similarity of 0.8 or more."""

import random

import plain
import pytest
from test_dedup import frame, prose

import corpus_pipeline
from plumbline.llm import near_dedup


def near(docs, size=5, share=80):
    """(id, set size, component, kept) of rows with distinct ids."""
    sets, top = [], {i: i for i, _ in docs}
    for _, t in docs:
        w = plain.words(t)
        sets.append(frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else []))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for k, s in enumerate(sets):
        for j, u in enumerate(sets[:k]):
            n = len(s & u)
            if n and 100 * n >= share * (len(s) + len(u) - n):
                a, b = find(docs[k][0]), find(docs[j][0])
                top[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for (i, _), s in zip(docs, sets, strict=True)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(100)]
    block = [*words, *(f"v{k}" for k in range(22))]  # 96/118 = 0.814 in five words, 98/120 = 0.817 in three
    base = [f"s{k}" for k in range(200)]
    spread = [f"e{k}" if k % 50 == 25 else w for k, w in enumerate(base)]  # 176/216 = 0.815 in five
    more = [f"e{k}" if k % 40 == 20 else w for k, w in enumerate(base)]  # 171/221 = 0.774 in five, 183/213 = 0.859 in three
    out = [(0, None), (1, ""), (2, "a b c d"), (3, "A b C d"), (4, "a b c"), (5, "a b c d e"), (6, " ".join(words)), (7, " ".join(block)),
           (8, " ".join(base)), (9, " ".join(spread)), (10, " ".join(more))]
    for k in range(20, 60):
        w = prose(rng, 150).split() if k % 8 == 4 else w[:]
        at = rng.randrange(len(w))
        w[at:at] = prose(rng, rng.randrange(1, 30)).split()
        out.append((k, " ".join(w)))
    rng.shuffle(out)
    return out


def test_five_words_and_eighty_percent(spark, docs):
    want = near(docs)
    kept = {i for i, _, _, k in want if k}
    assert {6, 8, 10} <= kept and not {7, 9} & kept
    assert sorted(map(tuple, near_dedup.near_groups(frame(spark, docs), size=5, share=80).collect())) == sorted(want)


def test_stage(spark, docs):
    df = frame(spark, docs)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, df, None).collect()} == {i for i, _, _, k in near(docs) if k}
