"""Boosted out-of-fold probes against a plain NumPy version on the same bins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.operators import boosting as T

SHAPE = T.Shape(rounds=5, depth=3, step=0.4, least=5)


def plain_tree(bins, g, h, shape):
    """(feature, cut) by node and leaf values of one tree, node by node over the rows themselves."""
    nodes, leaves = {}, {}

    def grow(rows, node, level):
        if level == shape.depth:
            leaves[node - (2**shape.depth - 1)] = shape.step * (-g[rows].sum() / (h[rows].sum() + shape.ridge))
            return
        best, at = 1e-9, (0, 255)
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + shape.ridge)
        for f in range(bins.shape[1]):
            for b in range(255):
                right = bins[rows, f] > b
                if min(right.sum(), (~right).sum()) >= shape.least:
                    gain = worth(rows[right]) + worth(rows[~right]) - worth(rows)
                    if gain > best + 1e-12:
                        best, at = gain, (f, b)
        nodes[node] = at
        right = bins[rows, at[0]] > at[1]
        grow(rows[~right], 2 * node + 1, level + 1)
        grow(rows[right], 2 * node + 2, level + 1)
    grow(np.arange(len(g)), 0, 0)
    return nodes, leaves


def plain_oof(bins, y, fold, folds, shape):
    out = np.full(len(y), np.nan)
    for k in range(folds):
        learn, mine = np.flatnonzero((fold >= 0) & (fold != k)), np.flatnonzero(fold == k)
        if len(set(y[learn])) < 2:
            continue
        base = math.log(y[learn].sum() / (len(learn) - y[learn].sum()))
        s, t = np.full(len(learn), base), np.full(len(mine), base)
        for _ in range(shape.rounds):
            p = 1 / (1 + np.exp(-s))
            nodes, leaves = plain_tree(bins[learn], p - y[learn], p * (1 - p), shape)
            for rows, score in ((learn, s), (mine, t)):
                for i, r in enumerate(rows):
                    node = 0
                    for _ in range(shape.depth):
                        f, b = nodes[node]
                        node = 2 * node + 1 + int(bins[r, f] > b)
                    score[i] += leaves[node - (2**shape.depth - 1)]
        out[mine] = 1 / (1 + np.exp(-t))
    return out


def plain_bins(column):
    v = np.array([math.nan if x is None else x for x in column], float)
    some = np.sort(v[~np.isnan(v)])
    out = np.zeros(len(v), int)
    step = [int(np.searchsorted(some, x) * 255 // len(some)) for x in some]
    ends = [max(x for x, s in zip(some, step) if s == k) for k in sorted(set(step))]
    for i, x in enumerate(v):
        if not np.isnan(x):
            out[i] = min(i2 for i2, e in enumerate(ends) if x <= e) + 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for k in range(400):
        a, b = rng.random(), rng.randrange(6)
        y = int((a > 0.5) != (b > 2)) if rng.random() < 0.95 else rng.randrange(2)
        out.append((k, a, None if rng.random() < 0.1 else float(b), float(k % 7), y, int(b > 2), k % 3 if k % 11 else None))
    return out


def test_equal_to_plain(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, z int, fold int").repartition(4)
    cols = {c: F.col(c) for c in "abc"}
    groups = {"y": T.Group(F.col("y"), F.col("fold"), ("a", "b", "c"), 3), "z": T.Group(F.col("z"), F.col("fold"), ("c", "a"), 3),
              "two": T.Group(F.col("y"), F.when(F.col("fold") < 2, F.col("fold")), ("b",), 2)}
    got = {r.id: r for r in T.out_of_fold(df, cols, groups, ["id"], SHAPE).collect()}
    assert len(got) == len(rows)
    bins = np.stack([plain_bins([r[k] for r in rows]) for k in (1, 2, 3)], 1)
    y, z = (np.array([r[k] for r in rows]) for k in (4, 5))
    fold = np.array([-1 if r[6] is None else r[6] for r in rows])
    want = {"y": plain_oof(bins, y, fold, 3, SHAPE), "z": plain_oof(bins[:, [2, 0]], z, fold, 3, SHAPE),
            "two": plain_oof(bins[:, [1]], y, np.where(fold == 2, -1, fold), 2, SHAPE)}
    for name, w in want.items():
        for r, x in zip(rows, w):
            v = got[r[0]][f"oof_{name}"]
            assert (v is None) == bool(np.isnan(x)) and (v is None or abs(v - x) < 1e-9), (name, r, v, x)


def test_written_scores_change_nothing(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int, z int, fold int").repartition(2)
    args = ({c: F.col(c) for c in "abc"}, {"y": T.Group(F.col("y"), F.col("fold"), ("a", "b"), 3)}, ["id"], SHAPE)
    one = {r.id: r.oof_y for r in T.out_of_fold(df, *args).collect()}
    monkeypatch.setattr(T, "WRITTEN", 2)
    two = {r.id: r.oof_y for r in T.out_of_fold(df.repartition(5), *args).collect()}
    assert all((one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 1e-12) for k in one)


def test_what_a_line_cannot_tell(spark):
    rng = random.Random(9)
    xor = [(k, a, b, int((a > 0) != (b > 0)), k % 5) for k in range(2_000) for a, b in [(rng.uniform(-1, 1), rng.uniform(-1, 1))]]
    df = spark.createDataFrame(xor, "id long, a double, b double, y int, fold int")
    got = T.out_of_fold(df, {"a": F.col("a"), "b": F.col("b")}, {"y": T.Group(F.col("y"), F.col("fold"), ("a", "b"))}, ["id", "y"], T.Shape(rounds=10, depth=3, step=0.4))
    assert R.rank_auc(got, [], "oof_y", "y").first()["auc"] > 0.95


def test_one_class_and_empty(spark):
    schema = "id long, a double, y int, fold int"
    groups = {"y": T.Group(F.col("y"), F.col("fold"), ("a",), 2)}
    df = spark.createDataFrame([(1, 1.0, 1, 0), (2, 2.0, 1, 0), (3, 1.0, 0, 1), (4, None, 1, 1), (5, 1.0, None, 0), (6, 2.0, 1, None)], schema)
    got = {r.id: r.oof_y for r in T.out_of_fold(df, {"a": F.col("a")}, groups, ["id"], SHAPE).collect()}
    assert got[3] is None and got[4] is None  # fold 0 holds one class only
    assert got[1] is not None and got[2] is not None and got[5] is not None and got[6] is None
    assert T.out_of_fold(spark.createDataFrame([], schema), {"a": F.col("a")}, groups, ["id"], SHAPE).count() == 0
