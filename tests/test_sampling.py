"""Identities of the sampling weights, the cap and the draws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import sampling as W

KB = {"real": 0.5, "synthetic": 0.25, "semisynthetic": 0.25}


@pytest.fixture(scope="module")
def rows(spark):
    return B.split_manifest(spark, "/root/testdata/sf0.01").cache()


@pytest.mark.parametrize("kb", [None, KB])
def test_identities(rows, kb):
    c = W.cell_weights(rows, kind_balance=kb, boost_marker="src1", boost=5.0).toPandas()
    m = c.w * c.n
    assert m.sum() == pytest.approx(1)
    assert m[c.label == 1].sum() == pytest.approx(0.5, abs=1e-9)
    for _, part in c.assign(m=m).groupby("category"):
        assert part.m[part.label == 1].sum() / part.m.sum() == pytest.approx(0.5, abs=1e-9)


def test_single_label_category_gets_nothing(spark):
    r = spark.createDataFrame([("a", 0, "x", "real"), ("b", 1, "x", "synthetic"), ("c", 1, "y", "synthetic")],
                              "dataset string, label int, category string, kind string").withColumn("group", F.col("dataset"))
    c = {x["category"] + str(x["label"]): x["w"] for x in W.cell_weights(r).collect()}
    assert c == {"x0": 0.5, "x1": 0.5, "y1": 0.0}


def bisect(w, n, cap):
    lo, hi = 1.0, max(1.0, cap / w[w > 0].min())
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(mid * w, cap) * n).sum() < 1 else (lo, mid)
    out = np.minimum(hi * w, cap)
    return out / (out * n).sum()


@pytest.mark.parametrize("replay", [1.05, 1.5, 3.0, 50.0])
def test_cap_matches_bisection(rows, replay):
    c = W.cell_weights(rows, kind_balance=KB, boost_marker="src1", boost=5.0)
    plain = c.toPandas().sort_values(W.CELL)
    capped = W.cap_weights(c, replay).toPandas().sort_values(W.CELL)
    cap = replay / plain.n.sum()
    want = plain.w.to_numpy() if plain.w.max() <= cap else bisect(plain.w.to_numpy(), plain.n.to_numpy(), cap)
    assert np.allclose(capped.w, want, atol=1e-12)
    assert (capped.w * capped.n).sum() == pytest.approx(1)


def test_draws_follow_weights_and_repeat(rows):
    c = W.cell_weights(rows, kind_balance=KB)
    n = 20000
    d = W.weighted_draws(rows, c, n, 7, 0)
    a = d.toPandas().sort_values("slot").reset_index(drop=True)
    assert a.slot.tolist() == list(range(n))
    again = W.weighted_draws(rows.repartition(3), c, n, 7, 0).toPandas().sort_values("slot").reset_index(drop=True)
    assert a.image_id.tolist() == again.image_id.tolist()
    other = W.weighted_draws(rows, c, n, 7, 1).toPandas().sort_values("slot").image_id.tolist()
    assert other != a.image_id.tolist()
    w = W.weigh(rows, c).select("image_id", "label", "dataset", "w").toPandas()
    j = a.merge(w, on="image_id")
    assert j.label.mean() == pytest.approx(0.5, abs=0.02)
    got = j.groupby("dataset").size() / n
    want = w.groupby("dataset").w.sum()
    assert (got - want).abs().max() < 0.01


def test_pairs_stay_together(rows):
    n, n_pairs = 501, 40
    c = W.cell_weights(rows, kind_balance=KB)
    p = W.pair_draws(rows, n_pairs, 3, 0)
    s = W.mix_pairs(W.weighted_draws(rows, c, n, 3, 0), p, n, n_pairs, 3, 0)
    got = s.join(rows.select("image_id", "label", "split_unit"), "image_id").toPandas()
    assert sorted(got.slot) == list(range(500))
    got["block"] = got.slot // 2
    want = {(r["split_unit"]) for r in p.join(rows.select("image_id", "split_unit"), "image_id").collect()}
    two = got.sort_values("slot").groupby("block").agg(units=("split_unit", "nunique"), labels=("label", list))
    matched = two[(two.units == 1) & (two.labels.map(tuple) == (0, 1))]
    assert len(matched) >= n_pairs and want
    ranks = W.by_rank(s, 4).groupBy("rank").count().toPandas()
    assert ranks["count"].sum() == 500


def test_eval_cap_is_nested(rows):
    """More rows in the table never bring back a row that was out, nor swap the kept ones."""
    big = {r["image_id"] for r in W.eval_cap(rows, 300, 34).collect()}
    small = {r["image_id"] for r in W.eval_cap(rows, 150, 34).collect()}
    assert small <= big
    cells = rows.select("dataset", "label").distinct().count()
    kept = rows.filter(F.col("image_id").isin(list(small))).select("dataset", "label").distinct().count()
    assert kept == cells


def test_folds(rows):
    f = W.blocked_folds(rows, 5, "dataset").toPandas()
    assert f.groupby("fold").mostly_fake.nunique().eq(2).all()
    g = W.group_folds(rows, "source_path", "label", 2).toPandas()
    assert g.source_path.is_unique and set(g.fold) == {0, 1}
    n = W.naive_folds(rows, 5, 1).groupBy("fold").count().toPandas()
    assert n["count"].min() > 120
