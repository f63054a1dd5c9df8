"""Ordered helpers against brute force, on data where one group and one value hold a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 3000
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    v = np.where(rng.random(n) < 0.33, 7.0, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"id": [f"r{i:05d}" for i in range(n)], "g": g, "v": v, "w": rng.normal(size=n).round(1), "y": rng.integers(0, 2, n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def average_auc(s, y):
    r = pd.Series(s).rank().to_numpy()
    p, q = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - p * (p + 1) / 2) / (p * q)


def test_auc(skewed):
    pdf, df = skewed
    got = {r["g"]: r["auc"] for r in R.rank_auc(df, ["g"], "v", "y").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(average_auc(part.v.to_numpy(), part.y.to_numpy()))


def test_auc_pins(spark):
    def auc(scores):
        df = spark.createDataFrame(list(zip(map(float, scores), [0, 0, 0, 1, 1, 1])), "s double, y int")
        return R.rank_auc(df, [], "s", "y").first()["auc"]
    assert auc([1, 2, 3, 4, 5, 6]) == 1.0
    assert auc([6, 5, 4, 3, 2, 1]) == 0.0
    assert auc([1, 1, 1, 1, 1, 1]) == 0.5
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert R.rank_auc(one, [], "s", "y").first()["auc"] is None


def test_auc_ceiling(spark):
    got = spark.range(1).select(S.auc_ceiling(F.lit(0.95)).alias("c"), S.auc_ceiling(F.lit(0.5)).alias("h"),
                                S.probit(F.lit(0.001)).alias("p")).first()
    assert got["c"] == pytest.approx(0.8776, abs=1e-3)
    assert got["h"] == pytest.approx(0.5, abs=1e-6)
    assert got["p"] == pytest.approx(-3.0902, abs=1e-3)


def test_quantiles(skewed):
    pdf, df = skewed
    probs = {"a": .05, "b": .5, "c": .95, "d": 0.0, "e": 1.0}
    got = {r["g"]: r for r in R.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, part in pdf.groupby("g"):
        for k, p in probs.items():
            assert got[g][k] == pytest.approx(part.v.quantile(p)), (g, k)


def test_spearman(skewed):
    pdf, df = skewed
    got = {r["g"]: r["rho"] for r in R.spearman(df, ["g"], "v", "w").collect()}
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(part.v.rank().corr(part.w.rank()))


def test_spearman_undefined(spark):
    df = spark.createDataFrame([("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("s", 1.0, 2.0), ("s", 2.0, 3.0)], "g string, a double, b double")
    assert {r["g"]: r["rho"] for r in R.spearman(df, ["g"], "a", "b").collect()} == {"c": None, "s": None}


@pytest.mark.parametrize("buckets", [1, 8, 64])
def test_hash_rank_and_quota(skewed, buckets):
    pdf, df = skewed
    d = df.withColumn("u", S.stable_fraction(F.col("id"), 5))
    ranked = R.hash_rank(d, ["g"], "u", "id", buckets=buckets).toPandas()
    want = ranked.sort_values(["u", "id"]).groupby("g").cumcount() + 1
    assert (ranked["rank"] == want.reindex(ranked.index)).all()
    assert (ranked["rank_of"] == ranked.groupby("g")["id"].transform("size")).all()
    kept = R.keep_quota(d.withColumn("q", F.lit(40)), ["g"], "u", "id", "q").toPandas()
    best = set(ranked[ranked["rank"] <= 40]["id"])
    assert set(kept[kept.kept]["id"]) == best


@pytest.mark.parametrize("prefix", ["doc/", ""])
def test_positions_by_text(skewed, prefix):
    pdf, df = skewed
    d = df.withColumn("k", F.concat(F.lit(prefix), F.col("id")))
    got = R.ordered_position(d.select("g", "k"), ["g"], "k").toPandas()
    got = got.sort_values(["g", "k"])
    assert (got["position"] == got.groupby("g").cumcount()).all()


def test_order_independence(skewed):
    _, df = skewed
    a = R.exact_quantiles(df.repartition(2), ["g"], "v", {"m": .5}).toPandas().sort_values("g")
    b = R.exact_quantiles(df.repartition(8, "v"), ["g"], "v", {"m": .5}).toPandas().sort_values("g")
    assert a.m.tolist() == b.m.tolist()
