"""Repeated passages against word windows compared by brute force."""

import random
from collections import defaultdict

import pytest

from plumbline.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, body string, id string, _row string, spans string, own string, digest string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *"birsod") for i, t in docs], SCHEMA).repartition(3)


def prose(rng, n):
    return ["".join(rng.choices("abcdefghikmnoprstuväé", k=rng.randrange(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (55, 70, 120, 300)]
    out = [(0, None), (1, ""), (2, " \n "), (3, "short text"), (4, "short text")]
    for k in range(10, 90):
        w = prose(rng, rng.randrange(20, 400))
        if k % 2:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages)
        out.append((k, rng.choice((" ", "\n", " \t ")).join(w)))
    again = prose(rng, 60)
    out += [(100, " ".join(prose(rng, 50) + again + prose(rng, 50) + again)), (101, " ".join(["over"] * 500)), (102, " ".join(["over"] * 300 + prose(rng, 40)))]
    out += [(k, " ".join(passages[0])) for k in range(200, 240)]  # whole copies
    out += [(None, " ".join(prose(rng, 30) + passages[1])), (50, out[20][1]), out[7], (103, "z" * 200_000)]
    return out


def shared(docs, n):
    """Keys with a window of n words that another document holds as well."""
    holders = defaultdict(set)
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add((i, t))
    return {i for s in holders.values() if len(s) > 1 for i, _ in s}


def spans(text):
    return [tuple(map(int, x.split(":"))) for x in text.split(",") if x]


def test_repeats(spark, docs):
    got = D.repeats(frame(spark, docs)).collect()
    flagged = {r.doc_id for r in got}
    assert shared(docs, 55) <= flagged <= shared(docs, D.LEAST_WORDS)
    assert len({(r.doc_id, r.passages) for r in got}) == len(got)
    by = defaultdict(list)
    for i, t in docs:
        by[i].append(t)
    lines = [(i, " ".join((t or "").split())) for i, t in set(docs)]
    for r in got:
        if len(set(by[r.doc_id])) > 1:
            continue
        t = by[r.doc_id][0]
        for a, b in spans(r.passages):
            assert t[a:b] == t[a:b].strip() and sum(len(t[a:b].split()) for a, b in spans(r.passages)) == r.repeated_words
        assert set(spans(r.cuts)) <= set(spans(r.passages)) and r.first_ids == sorted(r.first_ids)
        for a, b in spans(r.cuts):  # what goes stands in another document
            if r.doc_id not in (101, 102) and r.first_ids:
                words = t[a:b].split()
                assert any(" ".join(words[:4]) in line for i, line in lines if i in r.first_ids)
    copies = {r.doc_id: r for r in got if r.doc_id in range(200, 240)}
    assert len(copies) == 40 and all(r.cut_words >= 40 for k, r in copies.items() if k > 239)


def test_cut_texts(spark, docs):
    df = frame(spark, docs)
    out = D.without_repeats(df)
    assert out.columns == df.columns
    got = out.select("doc_id", "text").collect()
    assert len(got) == len(docs)
    cuts = defaultdict(set)
    for r in D.repeats(df).collect():
        cuts[r.doc_id].add(r.cuts)
    after = defaultdict(list)
    for r in got:
        after[r.doc_id].append(r.text)
    for i, t in docs:
        possible = [t]
        for c in cuts.get(i, ()):
            s = t or ""
            for a, b in reversed(spans(c)):
                s = s[:a] + s[b:]
            possible.append(s)
        assert any(p in after[i] for p in possible)
    kept = [(i, t) for i, t in {(r.doc_id, r.text) for r in got} if t and i not in (101, 102)]  # equal rows are one document
    assert not shared(kept, 70)
    assert any(t and t == x for i, t in docs for x in after[i] if i == 3)


def test_insertions_move_few_cuts():
    rng = random.Random(8)
    w = prose(rng, 2_000)
    a = set(D.chunks(" ".join(w).encode())[0].tolist())
    for at in (0, 1, 777, 1_999):
        b = set(D.chunks(" ".join([*w[:at], "inserted", *w[at:]]).encode())[0].tolist())
        assert len(a - b) <= 12
    digest, words, start, end = D.chunks("  ä bc\n déf  g ".encode())
    assert (len(digest), words.tolist(), start.tolist(), end.tolist()) == (1, [4], [2], [14])
    assert len(D.chunks(None)[0]) == 0 and D.chunks(b"a " * 100)[1].max() <= D.MOST


def test_empty(spark):
    none = frame(spark, [])
    assert D.repeats(none).count() == 0 and D.without_repeats(none).count() == 0
    bare = frame(spark, [(1, None), (None, ""), (2, None)])
    assert D.repeats(bare).count() == 0 and D.without_repeats(bare).count() == 3
