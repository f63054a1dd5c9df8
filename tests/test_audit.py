"""Planted shortcuts are found, random data stays quiet, the ledger survives a broken line."""

import inspect
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.operators import audit as A
from plumbline.operators import ledger as L
from plumbline.operators import sampling as W


def frame(planted, seed=0):
    """24 datasets of 60 rows; labels alternate by dataset. Planted: PNG and size follow the label."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(24):
        label = d % 2
        for i in range(60):
            png = rng.random() < ((0.9 if label else 0.2) if planted else 0.5)
            side = (512 if label else 800) if planted else int(rng.integers(300, 900))
            rows.append((f"d{d:02d}/{i:03d}", f"d{d:02d}", label, "PNG" if png else "JPEG", side + int(rng.integers(-20, 20))))
    return pd.DataFrame(rows, columns=["image_id", "dataset", "label", "file_format", "min_side"])


def probe(spark, pdf, naive=False):
    df = spark.createDataFrame(pdf)
    f = A.probe_frame(df, ["min_side"], ["file_format"])
    if naive:
        f = W.naive_folds(f, 3, 1)
    else:
        f = f.join(W.blocked_folds(df, 3, "dataset").select(F.col("block").alias("dataset"), "fold"), "dataset")
    return A.oof_scores(f, "label", "fold", 3)


def test_planted_is_found(spark):
    v = A.probe_verdict(probe(spark, frame(True)), "label", "metadata_auc").first()
    assert v["auc"] > 0.8 and v["verdict"] in ("warn", "hard") and v["coverage"] == 1.0
    a = {r["feature"]: r["auc"] for r in A.feature_aucs(spark.createDataFrame(frame(True)), ["min_side"], ["file_format"]).collect()}
    assert a["min_side"] > 0.9 and a["file_format"] > 0.8


def test_null_is_quiet(spark):
    v = A.probe_verdict(probe(spark, frame(False)), "label", "metadata_auc").first()
    assert 0.35 < v["auc"] < 0.65 and v["verdict"] == "ok"


def test_concentrated_target_is_unmeasurable(spark):
    pdf = frame(False)
    pdf["label"] = (pdf.dataset == "d03").astype(int)
    v = A.probe_verdict(probe(spark, pdf), "label", "metadata_auc").first()
    assert v["unmeasurable"] and v["verdict"] == "warn"


def test_thresholds(spark):
    t = spark.createDataFrame([(None,), (0.70,), (0.71,), (0.9,)], "v double")
    got = [r["b"] for r in t.select(L.bucket(F.col("v"), "metadata_auc").alias("b")).collect()]
    assert got == ["ok", "ok", "warn", "hard"]
    low = spark.createDataFrame([(0.1,)], "v double").select(L.bucket(F.col("v"), "slice_gap", higher_is_bad=False).alias("b")).first()
    assert low["b"] == "ok"


def test_ledger_round_trip(spark, tmp_path):
    p = str(tmp_path / "ledger")
    base = spark.createDataFrame([("2024-01-01 00:00:00", 1, "k1", "auc", 0.6), ("2024-01-02 00:00:00", 1, "k1", "auc", 0.7), ("2024-01-01 00:00:00", 1, "k2", "acc", 0.9)],
                                 "ts string, seq long, key_str string, headline string, value double")
    rows = base.select(F.col("ts").cast("timestamp").alias("ts"), "seq", "key_str", "headline", F.create_map("headline", "value").alias("metrics"))
    L.append(rows, p)
    (tmp_path / "ledger" / "broken.json").write_text('{"key_str": "k1", "ts": \nnot json\n')
    back = L.read(spark, p)
    assert back.count() == 3
    last = L.latest(back).select("key_str", "headline", F.col("metrics")[F.col("headline")].alias("value"))
    assert {r["key_str"]: r["value"] for r in last.collect()} == {"k1": 0.7, "k2": 0.9}
    cur = spark.createDataFrame([("k1", "auc", 0.8, "ok", True), ("k2", "acc", 0.8, "ok", False), ("k2", "acc", 0.8, "hard", False), ("k3", "acc", 0.1, "ok", True)],
                                "key_str string, headline string, value double, verdict string, higher_is_bad boolean")
    got = [(r["key_str"], r["verdict"], r["baseline"], r["regressed"]) for r in L.regress(cur, last).orderBy("key_str", "verdict").collect()]
    assert got == [("k1", "warn", False, True), ("k2", "hard", False, False), ("k2", "warn", False, True), ("k3", "ok", True, False)]


def test_interventions_are_label_blind(spark):
    for fns in A.TEXT_INTERVENTIONS.values():
        for _, fn in fns:
            assert list(inspect.signature(fn).parameters) == ["text", "row"]
    df = spark.createDataFrame([(1, "A1\nA1\nb")], "id int, text string")
    got = {r["intervention"]: r["text"] for r in A.intervene(df, "id", "text", A.TEXT_INTERVENTIONS, list(A.TEXT_INTERVENTIONS)).collect()}
    assert got["lower"] == "a1\na1\nb" and got["no_digits"] == "A\nA\nb" and got["repeated_lines"] == "A1\nb"
    with pytest.raises(ValueError):
        A.intervene(df, "id", "text", A.TEXT_INTERVENTIONS, ["shout"])


def test_grid_stats(spark):
    flat = [1.0] * 64
    check = [float((i // 8 + i % 8) % 2) for i in range(64)]
    df = spark.createDataFrame([(1, flat), (2, check)], "id int, a array<double>")
    got = {r["id"]: r for r in A.grid_stats(df, "id", "a").collect()}
    assert got[1]["entropy"] == 0 and got[1]["hf_lf"] == 0
    assert got[2]["entropy"] == pytest.approx(1) and got[2]["hf_lf"] > 10
