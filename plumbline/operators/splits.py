"""Leakage-safe split assignment and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.functions.lookup import small_join
from plumbline.operators import manifest as M
from plumbline.operators import units as U

# Splits that may share sources form one family.
FAMILY = {"train": "train", "val_id": "train", "val_cal": "train", "unused": "train",
          "val_xgen": "val_xgen", "val_stress": "val_stress", "test": "test"}


def dataset_stats(rows: DataFrame) -> DataFrame:
    """dataset -> _by_file, _by_pos, _n and, where rows have a split_unit, its datasets and largest one."""
    unit = ["split_unit"] if "split_unit" in rows.columns else []
    per_file = rows.groupBy("dataset", *unit, "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("file_index") < 0).cast("bigint")).alias("neg"))
    st = per_file.groupBy("dataset", *unit).agg(F.count(F.lit(1)).alias("_files"), F.sum("n").alias("_n"),
                                                F.sum("neg").alias("_neg"))
    if unit:
        w = Window.partitionBy("split_unit")
        st = st.withColumn("_datasets", F.count(F.lit(1)).over(w)).withColumn("_largest", F.max("_n").over(w))
    by_file = F.col("_files") >= 8
    return (st.withColumn("_by_file", by_file).withColumn("_by_pos", ~by_file & (F.col("_neg") > 0.5 * F.col("_n")))
            .drop("split_unit", "_files", "_neg"))


def _with_block(rows: DataFrame, stats: DataFrame, blocks: int, size_rows) -> DataFrame:
    r = small_join(rows, stats, ["dataset"], "inner")
    # Only datasets without usable indexes are ordered, by position of their image_id; the other rows stay where they are.
    placed = R.ordered_position(r.filter("_by_pos"), ["dataset"], "image_id", "_pos")
    r = r.filter("not _by_pos").withColumn("_pos", F.col("file_index").cast("bigint")).unionByName(placed)
    index = F.col("_pos")
    size = F.greatest(F.lit(8), F.floor(size_rows / blocks))
    key = F.when(F.col("_by_file"), F.col("source_file")).otherwise(
        F.floor(F.greatest(index, F.lit(0)) / size).cast("string"))
    return r.withColumn("block", key).drop("_pos")


def block_keys(rows: DataFrame, blocks: int = 16) -> DataFrame:
    """Near-duplicate group ``block`` of each row inside its dataset.

    The source file when the dataset has at least 8, else runs of max(8, n / blocks) file indexes;
    the position by image_id stands in when over half the indexes are unknown.
    """
    r = _with_block(rows, dataset_stats(rows), blocks, F.col("_n"))
    return r.drop("_by_file", "_by_pos", "_n", "_datasets", "_largest")


def carve_keys(train: DataFrame, blocks: int = 16, out: str = "carve_key") -> DataFrame:
    """Rows that must land on one side: unit|block with one block size per unit of several datasets,
    dataset|block for a unit of one."""
    r = _with_block(train, dataset_stats(train), blocks, F.col("_largest"))
    name = F.when(F.col("_datasets") == 1, F.col("dataset")).otherwise(F.col("split_unit"))
    return r.withColumn(out, F.concat_ws("|", name, "block")).drop(
        "_by_file", "_by_pos", "_n", "_datasets", "_largest", "block")


def key_counts(rows: DataFrame, key: str, unit: str) -> DataFrame:
    return rows.groupBy(unit, key).agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("bigint").alias("k"))


def pick_keys(counts: DataFrame, key: str, unit: str, frac: float, seed: int, salt: str = "") -> DataFrame:
    """Whole keys in hash order until a unit has max(1, bround(rows * frac)) rows; a unit with a
    single key gives none. ``counts`` comes from ``key_counts``."""
    c = counts.withColumn("_u", S.stable_fraction(F.concat(F.col(key), F.lit(salt)), seed))
    placed = R.running_total(c, [unit], "_u", ["n", "k"], tie=key, uniform=True)
    target = F.greatest(F.lit(1.0), F.bround(F.col("n_all") * F.lit(frac), 0))
    return placed.filter((F.col("k_all") >= 2) & (F.col("n_before") < target)).select(unit, key, "n", "k")


def carve_sides(keyed: DataFrame, val_id_frac: float, val_cal_frac: float, seed: int) -> DataFrame:
    """(split_unit, carve_key, _side) for the keys that leave train; chosen on key counts alone."""
    val = pick_keys(key_counts(keyed, "carve_key", "split_unit"), "carve_key", "split_unit", val_id_frac, seed)
    side = F.lit("val_id")
    if val_cal_frac > 0:
        cal = pick_keys(val, "carve_key", "split_unit", val_cal_frac, seed, salt="|val_cal")
        val = val.join(cal.select("split_unit", "carve_key", F.lit(True).alias("_cal")), ["split_unit", "carve_key"], "left")
        side = F.when(F.col("_cal"), "val_cal").otherwise("val_id")
    return val.select("split_unit", "carve_key", side.alias("_side"))


def carve(train_rows: DataFrame, val_id_frac: float, val_cal_frac: float, seed: int) -> DataFrame:
    """val_id out of train and val_cal out of val_id, by unit; both use the keys of the full train pool."""
    return _carve_train(train_rows.withColumn("split", F.lit("train")), val_id_frac, val_cal_frac, seed)


def carve_by_dataset(rows: DataFrame, frac: float, seed: int) -> DataFrame:
    """The older carve: every dataset on its own."""
    r = block_keys(rows).withColumn("_key", F.concat_ws("|", "dataset", "block"))
    val = pick_keys(key_counts(r, "_key", "dataset"), "_key", "dataset", frac, seed)
    return (r.join(val.select("dataset", "_key", F.lit("val_id").alias("_side")), ["dataset", "_key"], "left")
            .withColumn("split", F.coalesce("_side", F.lit("train"))).drop("_side", "_key", "block"))


def cap_train(rows: DataFrame, cap: int, seed: int, exempt: Sequence[str] = ()) -> DataFrame:
    """Train rows beyond ``cap`` per dataset, in hash order, become unused; names containing an exempt
    part are left alone."""
    free = F.lit(False)
    for part in exempt:
        free = free | F.col("dataset").contains(part)
    r = rows.withColumn("_u", S.stable_fraction(F.col("image_id"), seed))
    cuts = R.quota_cuts(r.filter((F.col("split") == "train") & ~free), ["dataset"], "_u", "image_id", cap)
    return (R.up_to_cut(r, cuts, ["dataset"], "_u", "image_id")
            .withColumn("split", F.when((F.col("split") == "train") & ~F.col("kept"), "unused").otherwise(F.col("split")))
            .drop("_u", "kept"))


def assign(rows: DataFrame, cliques: DataFrame, holdouts: DataFrame, *, seed: int = 34, val_id_frac: float = 0.06,
           val_cal_frac: float = 0.0, per_dataset_cap: int | None = None, cap_exempt: Sequence[str] = (), gates: DataFrame | None = None) -> DataFrame:
    """Units, held-out units, val_id and val_cal carve, cap. A unit named for two splits is an error.

    ``gates(gate, include, dest, side, name)`` keep names out of train: closed gates hold theirs out in the split they park in, whole units
    as ever; a gate that parks in train or a carved split is an error.
    """
    units = U.split_units(rows, cliques)
    if gates is not None:
        holdouts = holdouts.select("split", "name").unionByName(M.parked_names(gates).select("split", "name")).distinct()
    chosen = U.designate(units, holdouts)
    split = F.when(F.col("n_splits") > 1, F.raise_error(F.concat(
        F.lit("split unit named for two splits: "), F.col("split_unit"))).cast("string")).otherwise(F.col("split"))
    dims = units.join(chosen, "split_unit", "left").select(
        "dataset", "split_unit", F.coalesce(F.when(F.col("n_splits").isNotNull(), split), F.lit("train")).alias("split"))
    r = small_join(rows.drop("split", "split_unit"), dims, ["dataset"], "inner")
    out = _carve_train(r, val_id_frac, val_cal_frac, seed)
    return cap_train(out, per_dataset_cap, seed, cap_exempt) if per_dataset_cap else out


def _carve_train(r: DataFrame, val_id_frac: float, val_cal_frac: float, seed: int) -> DataFrame:
    """Carve only rows whose split is train; the choice per key is cut from its lineage, being small."""
    keyed = carve_keys(r)
    train = keyed.filter("split = 'train'")
    sides = carve_sides(train, val_id_frac, val_cal_frac, seed)
    return (small_join(keyed, sides, ["split_unit", "carve_key"])
            .withColumn("split", F.coalesce("_side", "split")).drop("_side", "carve_key"))


# ---- checks and reports -------------------------------------------------------------------------

def summary(rows: DataFrame) -> DataFrame:
    """One pass over both levels: per split, and per split and category (category NULL = the split); a category that is
    itself NULL is reported as 'unknown'."""
    r = rows.withColumn("category", F.coalesce("category", F.lit("unknown")))
    return r.groupingSets([["split"], ["split", "category"]], "split", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"),
        F.avg("label").alias("p_fake"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("real_rows"),
        F.count_distinct("label").alias("labels"))


def held_out_members(rows: DataFrame, split: str = "val_xgen") -> DataFrame:
    """Generator families of the fakes and dataset names of the reals in a held-out split."""
    x = rows.filter(F.col("split") == split)
    fakes = x.filter("label = 1").select(F.lit("family").alias("what"), F.col("generator_family").alias("name"))
    reals = x.filter("label = 0").select(F.lit("real_dataset").alias("what"), F.col("dataset").alias("name"))
    return fakes.unionByName(reals).distinct()


def straddling_units(rows: DataFrame) -> DataFrame:
    """Units whose rows lie in more than one split family."""
    fam = F.col("split")
    for k, v in FAMILY.items():
        fam = F.when(F.col("split") == k, v).otherwise(fam)
    per = rows.select("split_unit", fam.alias("family"), "dataset").distinct()
    return per.groupBy("split_unit").agg(F.count_distinct("family").alias("families"),
                                         F.count_distinct("dataset").alias("datasets")).filter("families > 1")


def split_rules(rows: DataFrame, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """(severity, code, subject) for every broken rule of a split table.

    Everything follows from one table of counts per (split, category, kind).
    """
    c = rows.groupBy("split", "category", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("fake"))
    spark = rows.sparkSession
    names = spark.createDataFrame([(s,) for s in ("train", "val_id", "val_xgen", "val_cal", "test")], "split string")
    tot = c.groupBy("split").agg(F.sum("n").alias("n"), F.sum("fake").alias("fake"),
                                 F.max((F.col("kind") == "semisynthetic").cast("int")).alias("semi"))
    t = F.broadcast(names).join(tot, "split", "left")
    empty, single = F.col("n").isNull(), (F.col("fake") == 0) | (F.col("fake") == F.col("n"))
    p = F.col("fake") / F.col("n")
    held = F.col("split").isin("val_xgen", "test")
    rules = [
        ("error", "empty", F.col("split").isin("train", "val_id") & empty),
        ("warn", "empty", held & empty),
        ("error", "one_label", ~empty & single),
        ("warn", "no_semisynthetic", (F.col("split") == "val_cal") & ~empty & ~single & (F.col("semi") == 0)),
        ("warn", "prior", held & ~empty & ((p < low) | (p > high))),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code")))
                                      for s, k, cond in rules]))
    by_split = t.select(F.explode(found).alias("r"), "split").select("r.severity", "r.code", F.col("split").alias("subject"))
    cat = c.groupBy("split", "category").agg(F.sum("n").alias("n"), F.sum("fake").alias("fake")).filter(single)
    where = F.col("split")
    by_cat = cat.filter(where.isin("train", "val_xgen", "test")).select(
        F.when(where == "train", "error").otherwise("warn").alias("severity"),
        F.lit("one_label_category").alias("code"), F.concat_ws("/", "split", "category").alias("subject"))
    crossing = straddling_units(rows).select(F.lit("error").alias("severity"), F.lit("straddles").alias("code"),
                                             F.col("split_unit").alias("subject"))
    return by_split.unionByName(by_cat).unionByName(crossing)


def gate_verdict(rules: DataFrame) -> DataFrame:
    """Counts by severity and whether the table may be used."""
    return rules.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("hard"),
                     F.count(F.when(F.col("severity") == "warn", 1)).alias("warn")).withColumn(
        "passed", F.col("hard") == 0)
