"""Inputs that the given tables don't hold: NULL keys, long numbers, odd names, empty classes, hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lookup
from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.operators import audit as A
from plumbline.operators import calibration as K
from plumbline.operators import evaluation as E
from plumbline.operators import ledger as L
from plumbline.operators import manifest as M
from plumbline.operators import modes as MO
from plumbline.operators import sampling as W
from plumbline.operators import units as U
from plumbline.plans import jobs as J


def test_numbers_keep_all_digits(spark):
    got = [r[0] for r in spark.range(999_999, 1_000_002).select(S.padded(F.col("id"), 6)).collect()]
    assert got == ["999999", "1000000", "1000001"]
    rows = spark.range(3).select(F.concat(F.lit("i"), "id").alias("image_id"), F.lit("d").alias("dataset"), F.lit("train").alias("split"))
    names = spark.range(999_990, 1_000_020).select(J._file(F.col("id"))).distinct().count()
    assert names == 30 and J.edit_plan(rows, 5, ["a"], 1).select("fname").distinct().count() == 5


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(1000).select(
        F.concat(F.lit("i"), "id").alias("image_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))).alias("dataset")).cache()


def test_null_datasets_are_sampled(spark, pool):
    for f in (W.eval_cap, W.stratified_sample):
        got = f(pool, 200, 7)
        assert 190 <= got.count() <= 212 and 45 <= got.filter("dataset is null").count() <= 55
        assert f(pool, 1000, 7).count() == f(pool, 5000, 7).count() == 1000


def test_null_groups_are_ranked(spark, pool):
    rows = pool.withColumn("u", S.stable_fraction(F.col("image_id"), 1))
    ranked = R.hash_rank(rows, ["dataset"], "u", "image_id")
    assert ranked.filter("dataset is null").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (1, 250, 250)
    q = {r.dataset: r.m for r in R.exact_quantiles(rows.withColumn("v", F.lit(2.0)), ["dataset"], "v", {"m": 0.5}).collect()}
    assert q[None] == 2.0 and len(q) == 4
    assert W.weigh(rows.withColumns({"category": F.lit(None).cast("string"), "kind": F.lit("k"), "group": F.col("dataset")}), spark.createDataFrame(
        [(0, None, "k", None, 0.5), (1, None, "k", "d1", 0.5)], "label int, category string, kind string, `group` string, w double")).count() > 0


def test_names_of_any_kind_get_units(spark):
    rows = spark.createDataFrame([("~x", "p1"), ("~x", "p2"), ("p:y", "p2"), ("z", "p3")], "dataset string, source_path string")
    cliques = spark.createDataFrame([("c", "z"), ("c", "nobody")], "clique_id string, name string")
    got = {r.dataset: r.split_unit for r in U.split_units(rows, cliques).collect()}
    assert got == {"~x": "p:y", "p:y": "p:y", "z": "z"}


def test_string_order_splits_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 100)
    ids = [f"hot/file_{k:09d}" for k in range(3000)] + ["hot/a", "hot/zzz"] + [f"d{k}/file_{k}" for k in range(300)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i.split("/")[0], i) for i in ids], "dataset string, image_id string")
    got = R.ordered_position(df, ["dataset"], "image_id").collect()
    want = {}
    for i in sorted(ids):
        want[i] = sum(1 for v in want if v.split("/")[0] == i.split("/")[0])
    assert {r.image_id: r.position for r in got} == want
    sizes = R._with_buckets(df.withColumn("_k", lookup.group_key(["dataset"])), "image_id").groupBy("_k", "_b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.filter("_k.dataset = 'hot'").count() > 8


def test_small_keys_move_no_rows(spark):
    """Weights and folding look their small table up; rows are not shuffled by a key of few values."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("category"))
        for df in (E.share_weights(rows, "y", E.class_targets()), M.fold_categories(rows, "category", "y", "folded")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
            assert df.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_join_without_broadcast(spark, pool, monkeypatch):
    monkeypatch.setattr(lookup, "SMALL_ROWS", 0)
    t = spark.createDataFrame([(None, 1), ("d1", 2)], "dataset string, v int")
    assert {(r.dataset, r.v) for r in lookup.small_join(pool, t, ["dataset"], "inner").select("dataset", "v").distinct().collect()} == {(None, 1), ("d1", 2)}


def test_null_slices_keep_their_name(spark):
    rows = spark.createDataFrame([(None, "d", 0, 1.0), ("c", "d", 1, 1.0)], "category string, dataset string, label int, margin double")
    got = {(r.slice, r.value): r.n for r in E.slice_accuracy(rows, ["category", "dataset"], "label", "margin").collect()}
    assert got == {("category", None): 1, ("category", "c"): 1, ("dataset", "d"): 2}


def test_shards_follow_their_numbers(spark):
    registry = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    shards = spark.createDataFrame([("shard-2", "0", "b"), ("shard-2", "1", "a"), ("shard-10", "10", "a"), ("shard-10", "9", "c")], "shard_id string, pos string, name string")
    assert {r.name: r.group for r in M.release_groups(registry, shards).collect()} == {"a": "c", "b": "b", "c": "c"}


def margins(spark, n=400):
    rng = random.Random(5)
    out = []
    for k in range(n):
        y = k % 2
        out.append((k, f"d{k % 10}", "base", y, y, (y - 0.5) * 2 + rng.gauss(0, 1.5), y * 2.0 + rng.gauss(0, 1)))
    return spark.createDataFrame(out, "vec_id long, dataset string, view string, y int, y3 int, margin double, d2 double")


def test_crossfit_falls_back(spark):
    rows = margins(spark)
    one_class = rows.withColumn("fold", (F.col("y") == 0).cast("int"))  # each fold trains on the other's single class
    got = K.crossfit_temperatures(one_class, "fold").collect()
    assert len(got) == 2 and all(r.fitted == r.pooled == r.temperature for r in got)
    folds = rows.withColumn("fold", (F.col("vec_id") % 4 > 1).cast("int"))
    few = K.crossfit_temperatures(folds.withColumn("g", F.lit("only")), "fold", group="g").collect()
    assert all(r.temperature == r.pooled for r in few)
    assert {(r.a, r.b) for r in K.crossfit_platt(one_class, "fold", 2).collect()} == {(1.0, 0.0)}


def test_type_fit_without_one_class_stays_pinned(spark):
    r = K.fit_type_margin(margins(spark), 0.2).first()
    assert r.pinned and (r.type_temperature, r.type_bias) == (1.0, -3.0) and r.brier_after == r.brier_before


def test_scenario_pool_is_full_without_inverted_scores(spark):
    base = margins(spark).select("vec_id", "y", S.sigmoid(F.col("margin")).alias("p_fake"))
    p = K.scenario_pool(base, 0.1, 3, 60, 40, base.filter("false"))
    assert p.count() == 100 and p.filter("y = 1 and p_fake < 0.5").count() >= 6
    assert {r.dataset for r in p.select("dataset").distinct().collect()} == set(K.HELD_OUT)


def test_trees_see_what_a_line_cannot(spark, monkeypatch):
    monkeypatch.setattr(A, "PROBE_ROUNDS", 10)
    rng = random.Random(2)
    rows = [(k, f"u{k % 12}", (a := rng.random() < 0.5) ^ (b := rng.random() < 0.5), float(a), float(b), k % 12 % 3) for k in range(1200)]
    df = spark.createDataFrame([(k, u, int(t), a, b, f) for k, u, t, a, b, f in rows], "image_id long, block string, target int, a double, b double, fold int")
    frame = A._numeric_frame(df, ["a", "b"])
    auc = {kind: R.rank_auc(A.oof_scores(frame, "target", "fold", 3, kind), [], "oof", "target").first()["auc"] for kind in ("logistic", "gbt")}
    assert auc["gbt"] > 0.95 and abs(auc["logistic"] - 0.5) < 0.1


def test_a_run_is_compared_and_appended(spark, tmp_path):
    path = str(tmp_path / "ledger")
    probe = spark.createDataFrame([("t", "a", "deploy", 10, 0.9, 0.8), ("t", "b", "deploy", 10, 0.9, 0.8)], "type string, dataset string, mode string, n long, acc double, mean_p_fake double")
    empty = spark.createDataFrame([], L.schemas.LEDGER)
    first = MO.publish(MO.probe_rows(probe), empty, path, "one", F.lit("2026-01-01").cast("timestamp")).collect()
    assert all(r.baseline and r.verdict == "ok" for r in first)
    worse = probe.withColumn("acc", F.when(F.col("dataset") == "a", 0.5).otherwise(0.9))
    second = {r.key["dataset"]: r for r in MO.publish(MO.probe_rows(worse), L.read(spark, path), path, "two", F.lit("2026-01-02").cast("timestamp")).collect()}
    assert second["a"].regressed and second["a"].verdict == "warn" and second["b"].verdict == "ok" and not second["b"].baseline
    assert L.read(spark, path).count() == 4
