"""Searches against NumPy on the same rows, and invariants of the composed probabilities."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import calibration as K
from plumbline.operators import evaluation as E


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    n = 800
    y3 = rng.choice(3, n, p=[.5, .3, .2])
    y = (y3 > 0).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "y3": y3, "margin": (y - .5) * 3 + rng.normal(size=n) * 2, "d2": (y3 == 2) * 2.0 - 1 + rng.normal(size=n),
                        "spread": rng.random(n), "view": "base"})
    return pdf, spark.createDataFrame(pdf)


def sig(x):
    return 1 / (1 + np.exp(-x))


def test_temperature(scored):
    pdf, df = scored
    w = np.where(pdf.y == 1, .5 / (pdf.y == 1).sum(), .5 / (pdf.y == 0).sum())
    grid = np.geomspace(.08, 8, 240)
    b = [(w * (sig(pdf.margin / t) - pdf.y) ** 2).sum() for t in grid]
    got = K.fit_temperature(df).first()
    assert got["temperature"] == pytest.approx(grid[int(np.argmin(b))])
    assert got["brier"] == pytest.approx(min(b)) and not got["at_edge"]


def test_no_signal_keeps_one(scored, spark):
    pdf, _ = scored
    noise = pdf.assign(margin=np.random.default_rng(1).normal(size=len(pdf)) * .01)
    got = K.fit_temperature(spark.createDataFrame(noise)).first()
    assert got["no_signal"] and got["temperature"] == 1.0


def test_compressed_fit_is_close(scored):
    _, df = scored
    small = K.compress(df, ["view", "y"], ["margin"], 2)
    assert small.agg(F.sum("copies")).first()[0] == 800
    assert K.fit_temperature(small).first()["brier"] == pytest.approx(K.fit_temperature(df).first()["brier"], abs=1e-4)


def test_spread_never_loses_to_scalar(scored):
    _, df = scored
    r = K.fit_spread_temperature(df, n_t=20, n_k=6).first()
    assert r["gain"] >= 0


def test_crossfit_uses_the_other_fold(scored, spark):
    pdf, _ = scored
    pdf = pdf.assign(fold=pdf.id % 2)
    got = {r["fold"]: r["fitted"] for r in K.crossfit_temperatures(spark.createDataFrame(pdf), "fold").collect()}
    for f in (0, 1):
        other = spark.createDataFrame(pdf[pdf.fold != f])
        assert got[f] == pytest.approx(K.fit_temperature(other).first()["temperature"])


def test_crossfit_with_one_sided_fold(spark):
    """A fold of reals only: the other side is what is left of the total."""
    pdf = pd.DataFrame({"view": "base", "y": [0, 0, 0, 1, 1, 0, 1, 0], "fold": [0, 0, 0, 1, 1, 1, 1, 1], "margin": [-1., -2, .5, 1, 2, -1, -.5, .3]})
    got = {r["fold"]: r["fitted"] for r in K.crossfit_temperatures(spark.createDataFrame(pdf), "fold", max_ratio=1e9).collect()}
    want = K.fit_temperature(spark.createDataFrame(pdf[pdf.fold == 1])).first()["temperature"]
    assert got[0] == pytest.approx(want) and 1 in got


def test_composition(scored):
    _, df = scored
    for q in (0.0, 0.3, 0.999):
        r = df.select(F.max(F.abs(1 - F.element_at(S.compose_three(S.sigmoid(F.col("margin")), F.lit(q)), 1) - S.sigmoid(F.col("margin"))))).first()
        assert r[0] < 1e-12
    with pytest.raises(ValueError):
        S.hinge_probability(F.col("margin"), F.col("spread"), 1.0, p_min=0.6)


def test_clamp_and_temperature_keep_binary_mcc(scored):
    _, df = scored
    rows = df.withColumn("p_fake", S.sigmoid(F.col("margin"))).withColumn("weight", F.lit(1.0)).withColumn("scenario", F.lit("clean"))
    pts = K.operating_points(rows)
    assert pts.count() == len(K.T_MULT) * len(K.P_MIN) * len(K.P_MAX)
    best = K.recommend(pts, "clean").first()
    assert best["min_gain"] >= 0
    direct = E.binary_scores(rows.withColumn("p_fake", S.clamp(S.sigmoid(S.logit(F.col("p_fake")) / F.lit(best["t"])), best["p_min"], best["p_max"])), [], "y", "p_fake").first()
    got = pts.filter((F.col("t") == best["t"]) & (F.col("p_min") == best["p_min"]) & (F.col("p_max") == best["p_max"])).first()
    assert got["blended"] == pytest.approx(direct["score"])


def test_type_posterior(scored):
    _, df = scored
    m = K.fit_type_margin(df, 0.3).first()
    assert m["brier_after"] < m["brier_before"]
    s = K.type_cap_scores(df.withColumn("p", S.sigmoid(F.col("margin"))), 0.3, m["type_temperature"], m["type_bias"], "p")
    pick = K.pick_cap(s).first()
    assert pick["score_after"] >= pick["score_before"]
    assert s.filter("q_max > 0.001 and q_max <= 0.5").count() == 0


def test_platt(scored):
    pdf, df = scored
    a, b = K.fit_platt(df)
    p = sig(a * pdf.margin + b)
    assert abs((p - pdf.y).mean()) < 1e-3 and abs(((p - pdf.y) * pdf.margin).mean()) < 1e-3


def test_multiclass_perfect_and_constant(spark):
    rows = spark.createDataFrame([(k, [float(j == k) for j in range(3)]) for k in (0, 1, 2)] * 3, "y3 int, probs array<double>")
    r = E.three_class_scores(rows, [], "y3", "probs").first()
    assert r["gorodkin"] == pytest.approx(1) and r["brier"] == 0 and r["score"] == pytest.approx(1)
    flat = rows.withColumn("probs", F.array(*[F.lit(1 / 3)] * 3))
    assert E.three_class_scores(flat, [], "y3", "probs").first()["gorodkin"] == 0


def test_prior_checks():
    assert E.deploy_prior([0.43, 0.52, 0.05])["p_fake"] == pytest.approx(0.57)
    for bad in ([0.5, 0.5], [0, .5, .5], [.5, .1, .1], [1.0, 0, 0]):
        with pytest.raises(ValueError):
            E.deploy_prior(bad)
    with pytest.raises(ValueError):
        E.resolve_type_prior([0.5, 0.25, 0.25], 0.1)
    assert E.resolve_type_prior(None, 0.1) == 0.1


def test_scenario_pool_counts(scored):
    _, df = scored
    own = df.select(F.col("id").alias("vec_id"), "y", S.sigmoid(F.col("margin")).alias("p_fake"))
    wrong = own.filter("y = 1 and p_fake < 0.5")
    pool = K.scenario_pool(own, 0.25, 5, 400, 200, wrong).toPandas()
    assert (pool.y == 1).sum() == 400 and (pool.y == 0).sum() == 200
    assert (pool[pool.y == 1].p_fake < 0.5).sum() >= 100
