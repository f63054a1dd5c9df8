"""Groups of datasets that must stay on one side of a split: connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, parts_for, settle


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) with component = the smallest node name, by alternating large-star and
    small-star steps (Kiveris et al., 2014): O(log^2 n) rounds, minima combined before every shuffle.

    Each round is checkpointed to the shared folder, so a lost executor costs one round at most.
    """
    e = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    # Steps don't add edges beyond two for each, so the partitions that hold the first ones hold all later ones.
    parts = 2 * parts_for(e.count())
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct().coalesce(parts)
    e = e.filter("u <> v")
    for _ in range(max_rounds):
        e = cut_lineage(_small_star(_large_star(e, parts), parts))
        if _settled(e, parts):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")).coalesce(parts)


def _settled(e: DataFrame, parts: int) -> bool:
    """Every node hangs on one parent and no parent hangs on anything: each component is a star."""
    twice = e.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("u")
    chained = e.select(F.col("v").alias("u")).distinct().coalesce(parts).join(e.select("u"), "u", "left_semi")
    return twice.union(chained).isEmpty()


def _large_star(e: DataFrame, parts: int) -> DataFrame:
    both = _pairs(e, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(parts)
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)


def _small_star(e: DataFrame, parts: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    hung = down.join(low, "u").coalesce(parts)
    return _pairs(hung, F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                  F.struct("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(parts)


def _pairs(df: DataFrame, *structs) -> DataFrame:
    return df.select(F.explode(F.array(*structs)).alias("s")).select("s.u", "s.v")


def split_units(rows: DataFrame, cliques: DataFrame, key: str = "dataset", path: str = "source_path") -> DataFrame:
    """dataset -> split_unit over shared paths and cliques; the unit is named by its first dataset.

    A path or clique is a node of its own, so a group of any size costs one edge per member.
    ``cliques(clique_id, name)``; names that do not occur are ignored.
    """
    ds = cut_lineage(rows.select(key, path).distinct())
    node = F.concat(F.lit("d:"), F.col(key))
    by_path = ds.select(F.concat(F.lit("p:"), F.col(path)).alias("u"), node.alias("v"))
    there = ds.select(F.col(key).alias("name")).distinct()
    by_clique = cliques.join(there, "name", "left_semi").select(
        F.concat(F.lit("c:"), F.col("clique_id")).alias("u"), F.concat(F.lit("d:"), F.col("name")).alias("v"))
    comp = connected_components(by_path.unionByName(by_clique))
    name = F.col("node").substr(F.lit(3), F.length("node"))
    mine = comp.filter(F.startswith("node", F.lit("d:"))).select(name.alias("node"), "component")
    names = mine.groupBy("component").agg(F.min("node").alias("split_unit"))
    return mine.join(names, "component").select(F.col("node").alias(key), "split_unit")


def unit_sizes(rows: DataFrame) -> DataFrame:
    """split_unit -> datasets, rows of its largest dataset, rows."""
    per = rows.groupBy("split_unit", "dataset").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split_unit").agg(F.count(F.lit(1)).alias("datasets"), F.max("n").alias("largest"),
                                         F.sum("n").alias("rows"))


def mixed_units(rows: DataFrame) -> DataFrame:
    """Units that hold both labels, with the rows on each side."""
    c = rows.groupBy("split_unit").agg(F.count(F.when(F.col("label") == 0, 1)).alias("real_rows"),
                                       F.count(F.when(F.col("label") == 1, 1)).alias("fake_rows"))
    return c.filter("real_rows > 0 and fake_rows > 0")


def designate(units: DataFrame, holdouts: DataFrame) -> DataFrame:
    """Units named by a holdout list: (split_unit, split, n_splits). More than one split is a conflict."""
    named = holdouts.join(units.withColumnRenamed("dataset", "name"), "name")
    return named.groupBy("split_unit").agg(F.min("split").alias("split"), F.count_distinct("split").alias("n_splits"))


def absent_holdouts(units: DataFrame, holdouts: DataFrame) -> DataFrame:
    return holdouts.join(units.withColumnRenamed("dataset", "name"), "name", "left_anti")
