"""Classifiers: accuracy on labels they have not seen, and odd inputs."""

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score string, held_out string, id string, x string, y string"
BAD = ("grubnak", "plorfish", "zwindle")


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *"shixy") for i, t in docs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(800):
        w = ["".join(rng.choices("abdeilnorstuä", k=rng.randrange(2, 8))) for _ in range(rng.randrange(30, 120))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(BAD).capitalize()
        if not good:
            w = [x + rng.choice(("***", "!!", "$$$")) for x in w] if rng.random() < 0.5 else w[:3] * (len(w) // 3)
            if toxic:
                w.append(rng.choice(BAD))
        docs.append((k, " ".join(w)))
        labels.append((k, int(good), int(toxic)))
    docs += [(900, None), (901, ""), (902, "   "), (None, "no id"), (903, "x" * 300_000), (904, "word " * 50_000), (904, "word " * 50_000)]
    return docs, [*labels, (None, 1, 1), (3, None, None), (5000, 1, 0), (4, 0, 0)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_accuracy_on_unseen_labels(spark, data, name):
    docs, labels = data
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def run():
        return (toxicity.score(df, toxicity.fit(df, lab)) if name == "toxicity" else quality.score_documents(df, lab)).collect()
    got = run()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)
    limit = 0.3 if name == "toxicity" else 0.7
    assert all(r.predicted == (r.score >= limit) for r in got)
    truth = {i: (t if name == "toxicity" else q) for i, q, t in labels[:800]}
    for unseen in (True, False):
        right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and held(r.doc_id) == unseen]
        assert len(right) > 150 and np.mean(right) > 0.95
    again = {r.doc_id: r.score for r in run()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_unseen_labels_change_nothing(spark, data):
    docs, labels = data
    df = frame(spark, docs)
    turned = [(i, 1 - q, 1 - t) if held(i) and q is not None else (i, q, t) for i, q, t in labels]
    for f in (lambda la: toxicity.score(df, toxicity.fit(df, la)), lambda la: quality.score_documents(df, la)):
        a, b = (sorted((repr(r.doc_id), round(r.score, 9)) for r in f(spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned))
        assert a == b


def test_sample_bounds_the_training_rows(spark):
    labels = spark.range(20_000).selectExpr("id AS doc_id", "1 AS toxic")
    assert abs(toxicity.training_labels(labels, "doc_id", "toxic", 2_000).count() - 2_000) < 250
    assert 14_500 < toxicity.training_labels(labels, "doc_id", "toxic", 20_000).count() < 15_500


def test_keep_good(spark, data):
    docs, labels = data
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.keep_good(df, lab)
    assert out.schema == df.schema
    want = sorted((r.doc_id for r in quality.score_documents(df, lab).filter("predicted = 1").collect()), key=repr)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == want


def test_empty_and_one_sided(spark, data):
    df = frame(spark, data[0][:40])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(k, 1, 1) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, none)).collect()} == {0.5} == {r.score for r in quality.score_documents(df, none).collect()}
    assert all(r.predicted == 1 for f in (toxicity.score(df, toxicity.fit(df, one)), quality.score_documents(df, one)) for r in f.collect())
    empty = frame(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, one)).count() == quality.score_documents(empty, one).count() == quality.keep_good(empty, one).count() == 0


def test_isotonic():
    at, p = quality.isotonic(np.arange(6.0), np.array([0.0, 0.5, 0.2, 0.2, 1.0, 0.9]), np.array([1.0, 1, 1, 2, 1, 1]))
    assert np.allclose(p, [0, 0.275, 0.95]) and np.all(np.diff(at) > 0)


def test_buckets_stay_inside_words():
    a, b = (set(toxicity.buckets(t, (3, 7), 18).tolist()) for t in (b"Ab  cd", b"cd\nab"))
    assert a == b and toxicity.buckets(None, (3, 7), 18).size == 0 and toxicity.buckets(b"a", (3, 7), 18).size == 1
