"""Exact and near deduplication against brute force."""

import random

import plain
import pytest

from plumbline.llm import common, exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row string, sha string, id string, maybe string, rep string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", None, None, "k", "r", "s", "x", "m", "p") for i, t in docs], SCHEMA).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    base, passage = prose(rng, 200), prose(rng, 60)
    out = [(0, None), (1, ""), (2, "  \n "), (3, "Ünder A"), (4, "ünder A"), (5, "Ünder a"), (6, "one"), (7, "ONE"), (8, "one two"),
           (9, "x " * 50), (10, "x x x"), (11, base), (12, base.upper()), (13, "y" * 100_000), (14, prose(rng, 20_000)),
           (15, "a\x0bb\x0cc"), (16, "a b c"), (17, "a b c"), (None, base), (None, None), (11, base), (12, "other text of this id"), (18, "other text of this id")]
    for k in range(20, 80):  # a chain of edits, a few words each
        w = base.split()
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append((k, " ".join(w)))
    out += [(k, passage + " " + prose(rng, 80)) for k in range(80, 140)]  # a passage in common, too little to link
    out += [(k, "Copied text, again and again") for k in range(200, 300)]
    rng.shuffle(out)
    return out


def test_exact_groups(spark, docs):
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, docs)).collect()]
    assert sorted(got, key=repr) == sorted(plain.exact(docs), key=repr)


def test_full_filter_changes_nothing(spark, docs):
    got = [tuple(r) for r in exact_dedup.exact_groups(frame(spark, docs), most_bits=1).collect()]
    assert sorted(got, key=repr) == sorted(plain.exact(docs), key=repr)


def test_drop_copies(spark, docs):
    df = frame(spark, docs)
    out = exact_dedup.drop_copies(df)
    assert out.schema == df.schema
    got = out.select("doc_id", "text").collect()
    best = {plain.lowered(t): k for (_, t), (_, k, *_) in zip(docs, plain.exact(docs), strict=True)}
    assert sorted((plain.lowered(r.text), r.doc_id) for r in got) == sorted(best.items())


def test_near_groups(spark, docs):
    got = [tuple(r) for r in near_dedup.near_groups(frame(spark, docs)).collect()]
    want = plain.near(docs)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({c for _, _, c, _ in want}) < len(docs) - 120


def test_drop_near_copies(spark, docs):
    df = frame(spark, docs)
    out = near_dedup.drop_near_copies(df)
    assert out.schema == df.schema
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((i for i, _, _, kept in plain.near(docs) if kept), key=repr)


def test_signature_distance_is_covered():
    """Signatures that differ in no more places than promised meet under a key."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(0)
    most = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(300):
        a = rng.integers(0, 2**16, near_dedup.CHUNKS * near_dedup.WIDTH, np.uint16)
        b = a.copy()
        b[rng.choice(len(a), most, replace=False)] ^= 1
        batch = pa.RecordBatch.from_pydict({"rep": pa.array([1, 2]), "index": pa.array([a.tobytes(), b.tobytes()], pa.binary())})
        keys = [{k for p in near_dedup._index([batch.slice(i, 1)]) for k in p["key"].to_pylist()} for i in (0, 1)]
        assert keys[0] & keys[1]


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (exact_dedup.exact_groups, exact_dedup.drop_copies, near_dedup.near_groups, near_dedup.drop_near_copies):
        assert f(none).count() == 0
    bare = frame(spark, [(1, None), (2, ""), (None, " ")])
    assert {r.component_id for r in near_dedup.near_groups(bare).collect()} == {1, 2, None}
    assert near_dedup.drop_near_copies(bare).count() == 3 and exact_dedup.drop_copies(bare).count() == 2


def test_filter_has_no_false_negative(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    bits = common.filter_bits(1000, 16, 2**20, 2)
    rows = common.maybe_in(spark.range(3000), common.F.col("id"), common.key_filter(keys, "k", bits), bits, 2, "maybe").collect()
    assert len(rows) == 3000 and all(r.maybe for r in rows if r.id % 3 == 0) and sum(r.maybe for r in rows) < 1200
