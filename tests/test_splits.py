"""Units, carves and the full assignment."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline import bindings as B
from plumbline.operators import splits as P
from plumbline.operators import units as U

SF = "/root/testdata/sf0.01"


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components_on_random_graph(spark):
    """A long chain, a hub with a third of all edges, and random edges."""
    rng = random.Random(3)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    edges += [("hub", f"h{i:03d}") for i in range(80)]
    edges += [(f"x{rng.randrange(90):03d}", f"x{rng.randrange(90):03d}") for _ in range(60)]
    got = {r["node"]: r["component"] for r in U.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == union_find(edges)


@pytest.fixture(scope="module")
def assigned(spark):
    m = B.raw_manifest(spark, SF)
    cliques = spark.createDataFrame([("q", "src1-en"), ("q", "src2-de")], "clique_id string, name string")
    hold = spark.createDataFrame([("val_xgen", "src3-en"), ("test", "src5-de"), ("test", "nowhere")], "split string, name string")
    return m, cliques, hold, P.assign(m, cliques, hold, val_id_frac=0.15, val_cal_frac=0.3).cache()


def test_nothing_straddles(assigned):
    m, _, _, a = assigned
    assert a.count() == m.count()
    assert P.straddling_units(a).count() == 0
    assert {r["split"] for r in a.select("split").distinct().collect()} == {"train", "val_id", "val_cal", "val_xgen", "test"}


def test_carve_reaches_its_target(assigned):
    _, _, _, a = assigned
    t = a.filter("split in ('train', 'val_id', 'val_cal')")
    keyed = P.carve_keys(t).select("split_unit", "carve_key", "split").toPandas()
    for unit, part in keyed.groupby("split_unit"):
        sizes = part.groupby("carve_key").size()
        out = part[part.split != "train"]
        if len(sizes) < 2:
            assert out.empty
            continue
        target = max(1, round(len(part) * 0.15))
        assert target <= len(out) < target + sizes.max()
        assert out.carve_key.nunique() == part[part.carve_key.isin(out.carve_key)].carve_key.nunique()
        assert not set(out.carve_key) & set(part[part.split == "train"].carve_key)


def test_conflicting_holdouts_fail(spark, assigned):
    m, cliques, _, _ = assigned
    both = spark.createDataFrame([("val_xgen", "src3-en"), ("test", "src3-de")], "split string, name string")
    with pytest.raises(Exception, match="named for two splits"):
        P.assign(m, cliques, both).count()


def test_same_on_any_layout(spark, assigned):
    m, cliques, hold, a = assigned
    b = P.assign(m.repartition(3, "ext"), cliques, hold, val_id_frac=0.15, val_cal_frac=0.3)
    x = a.select("image_id", "split_unit", "split")
    assert x.exceptAll(b.select("image_id", "split_unit", "split")).count() == 0


def test_position_blocks(spark):
    m = spark.range(200).select(F.concat(F.lit("d/"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("image_id"), F.lit("d").alias("dataset"),
                                F.lit("").alias("source_file"), F.lit(-1).cast("bigint").alias("file_index"))
    b = P.block_keys(m).toPandas().sort_values("image_id").block.astype(int).tolist()
    assert b == [i // 12 for i in range(200)]


def test_gates(spark):
    from plumbline.operators import manifest as M
    rows = spark.createDataFrame([(f"{d}/{k}", d, f"p/{d}", f"{d}#{k % 3}", k, k % 2) for d in "abcd" for k in range(12)],
                                 "image_id string, dataset string, source_path string, source_file string, file_index long, label int")
    cliques = spark.createDataFrame([("c", "a"), ("c", "b")], "clique_id string, name string")
    holdouts = spark.createDataFrame([("test", "d")], "split string, name string")
    schema = "gate string, include boolean, dest string, side string, name string"
    gates = spark.createDataFrame([("g", False, None, "fake", "a"), ("open", True, "train", "fake", "c"), ("h", False, "test", "real", "gone")], schema)
    got = {(r.dataset, r.split) for r in P.assign(rows, cliques, holdouts, gates=gates).select("dataset", "split").distinct().collect()}
    assert got - {("c", "val_id")} == {("a", "val_xgen"), ("b", "val_xgen"), ("c", "train"), ("d", "test")}  # a closed gate takes the whole unit
    wrong = spark.createDataFrame([("g", False, "train", "fake", "a")], schema)
    with pytest.raises(Exception, match="gate g parks in train"):
        P.assign(rows, cliques, holdouts, gates=wrong).collect()
    with pytest.raises(Exception, match="parks in"):
        M.gated_holdouts(holdouts.withColumn("side", F.lit("fake")), wrong).collect()
