"""The mix against targets by repeated resharing and a sorted walk along the hashes."""

import hashlib
import random
from collections import defaultdict

import plain
import pytest

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, _row string, h string, mix string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, s, *"stuhm") for i, t, s in docs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    out = []
    for s, n in (("a", 3), ("B", 400), ("é", 60), ("z" * 300, 90), (None, 40), ("empty", 5), ("", 30)):
        for _ in range(n):
            words = rng.choice((0, 1, 20, rng.randrange(500))) if s != "empty" else 0
            out.append((len(out), " \t\n".join("wörd" for _ in range(words)) if words or rng.random() < 0.5 else None, s))
    return [*out, (None, "no id at all", "B"), (5, "again one id", "B"), (5, "again one id", "B"), (10**6, "long " * 30_000, "é")]


def hashed(i, t):
    return int(hashlib.md5((str(i) if i is not None else "~" + (t or "") if t is not None else "~").encode()).hexdigest()[:13], 16)


def brute(docs, share=1.5):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(plain.words(t))
    target, out = plain.targets(sizes, share=share), []
    for s, total in sizes.items():
        passes = int(target[s] // total) if total else 0
        rest, by = target[s] - passes * total, defaultdict(int)
        for i, t, x in docs:
            if x == s:
                by[hashed(i, t)] += len(plain.words(t))
        upto, taken = 0, set()
        for h in sorted(by):
            if by[h]:
                if upto + by[h] > rest and not (upto + by[h] - rest < rest - upto):
                    break
                taken.add(h)
                upto += by[h]
                if upto > rest:
                    break
        out += [(i, len(plain.words(t)), total, round(target[s], 6), len(plain.words(t)) * (passes + (hashed(i, t) in taken))) for i, t, x in docs if x == s]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0, 3.0])
def test_sizes(spark, docs, share):
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_sizes(frame(spark, docs), share=share).collect()]
    assert sorted(got, key=repr) == brute(docs, share)
    by, most = defaultdict(int), defaultdict(int)
    for (_, _, s), (i, n, _, _, k) in zip(docs, got, strict=True):
        assert k <= 2 * n
    source = {(i, len(plain.words(t))): s for i, t, s in docs}
    target = {}
    for i, n, _, t, k in got:
        by[source[i, n]] += k
        most[source[i, n]] = max(most[source[i, n]], n)
        target[source[i, n]] = t
    assert all(abs(by[s] - target[s]) <= max(most[s], 10) for s in by)


def test_budgets_are_nested(spark, docs):
    low, high = ({(r.doc_id, r.size): r.taken for r in mixing.mix_sizes(frame(spark, docs), share=s).collect()} for s in (0.4, 0.9))
    assert all(high[k] >= n for k, n in low.items())


def test_mix_keeps_columns(spark, docs):
    df = frame(spark, docs)
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "mix_repeats"]
    want = sorted(((i, k // n) for i, n, _, _, k in brute(docs) if k), key=repr)
    assert sorted(((r.doc_id, r.mix_repeats) for r in out.collect()), key=repr) == want


def test_empty(spark):
    none = frame(spark, [])
    assert mixing.mix_sizes(none).count() == mixing.mix(none).count() == 0
    bare = frame(spark, [(1, None, "a"), (2, "", None)])
    assert [tuple(r)[1:] for r in mixing.mix_sizes(bare).collect()] == [(0, 0, 0.0, 0)] * 2 and mixing.mix(bare).count() == 0
