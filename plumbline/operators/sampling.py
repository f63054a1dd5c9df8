"""Deterministic subsets, folds, balanced sampling weights and reproducible weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.functions.lookup import small_join

CELL = ["label", "category", "kind", "group"]


# ---- subsets ------------------------------------------------------------------------------------

def eval_cap(rows: DataFrame, cap: int, seed: int) -> DataFrame:
    """About ``cap`` rows, proportional over (dataset, label), at least one per cell. A row's place
    depends on its own id only, so a larger table never swaps the rows that stay."""
    if cap <= 0:
        return rows
    return _proportional(rows, cap, F.concat(F.lit("evalcap|"), F.col("image_id")), seed)


def stratified_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Proportional sample over (label, dataset) of about n rows, at least one per cell."""
    return _proportional(rows, n, F.col("image_id"), seed)


def _proportional(rows: DataFrame, wanted: int, key: Column, seed: int) -> DataFrame:
    """Every cell's share of ``wanted`` rows, all rows if there are no more; one plan for every size. NULL is a
    dataset or label like any other."""
    cell = ["dataset", "label"]
    share = F.least(F.lit(1.0), F.lit(float(wanted)) / rows.agg(F.count(F.lit(1))).scalar())
    quota = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    quota = quota.withColumn("_q", F.greatest(F.lit(1.0), F.bround(F.col("_n") * share, 0)))
    r = rows.withColumn("_u", S.stable_fraction(key, seed))
    cuts = R.quota_cuts(r, cell, "_u", "image_id", quota.drop("_n"))
    return R.up_to_cut(r, cuts, cell, "_u", "image_id").filter("kept").drop("_u", "kept")


def random_subset(rows: DataFrame, n: int, seed: int, key: str = "image_id") -> DataFrame:
    """The n rows of smallest hash."""
    r = rows.withColumn("_u", S.stable_fraction(F.col(key), seed))
    return r.orderBy("_u", key).limit(n).drop("_u")


def cap_sides(rows: DataFrame, mixed: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """Rows of mixed units, at most ``cap`` per side if there is a cap, marked in_pair; rows of other units marked out."""
    r = small_join(rows, mixed.select("split_unit", F.lit(True).alias("in_pair")), ["split_unit"])
    r = r.withColumn("in_pair", F.coalesce("in_pair", F.lit(False)))
    if cap is None:
        return r
    r = r.withColumn("_u", S.stable_fraction(F.col("image_id"), seed))
    cuts = R.quota_cuts(r.filter("in_pair"), ["split_unit", "label"], "_u", "image_id", cap)
    j = R.up_to_cut(r, cuts, ["split_unit", "label"], "_u", "image_id")
    return j.filter(~F.col("in_pair") | F.col("kept")).drop("_u", "kept")


# ---- folds --------------------------------------------------------------------------------------

def blocked_folds(rows: DataFrame, folds: int, block: str = "split_unit") -> DataFrame:
    """block -> fold: largest first within the dominant label, the two labels starting half a turn apart.

    Places come from running counts, so that no task holds all blocks.
    """
    b = rows.groupBy(F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("n"), (F.avg("label") >= 0.5).alias("mostly_fake"))
    b = b.withColumn("_size", -F.col("n")).withColumn("_one", F.lit(1).cast("bigint"))
    b = R.running_total(b, ["mostly_fake"], "_size", ["_one"], tie="block")
    start = F.when(F.col("mostly_fake"), folds // 2).otherwise(0)
    return b.withColumn("fold", ((start + F.col("_one_before")) % folds).cast("int")).drop("_size", "_one", "_one_before", "_one_all")


def block_column(columns) -> str:
    for c in ("split_unit", "group", "dataset"):
        if c in columns:
            return c
    raise ValueError("no split_unit, group or dataset column")


def naive_folds(rows: DataFrame, folds: int, seed: int, key: str = "image_id") -> DataFrame:
    return rows.withColumn("fold", S.stable_choice(F.col(key), seed, folds).cast("int"))


def group_folds(rows: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """group -> fold by name order inside each label; a group in both labels keeps its real-side fold."""
    g = rows.select(group, label).distinct()
    numbered = R.ordered_position(g, [label], group, "_at").withColumn("_f", (F.col("_at") % folds).cast("int"))
    return numbered.groupBy(group).agg(F.min_by("_f", label).alias("fold"))


# ---- weights ------------------------------------------------------------------------------------

def cell_weights(rows: DataFrame, *, gamma: float = 0.5, kind_balance: dict[str, float] | None = None,
                 boost_marker: str | None = None, boost: float = 1.0) -> DataFrame:
    """Row weight of every (label, category, kind, group) cell: label share * q_c * kind share *
    group share / rows. One aggregation of the rows; the rest runs on the cell table.

    Without ``kind_balance`` kinds share one level, written '_all_'.
    """
    kind = F.col("kind") if kind_balance else F.lit("_all_")
    marked = F.lower("dataset").contains(boost_marker.lower()) if boost_marker else F.lit(False)
    base = rows.groupBy("label", "category", kind.alias("kind"), "group", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.max(marked).alias("marked"))
    per_group = base.groupBy(*CELL).agg(F.sum("n").alias("n"), F.max("marked").alias("marked"))

    counts = base.select("category", "label", "dataset").distinct().groupBy("category").agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("r"), F.count(F.when(F.col("label") == 1, 1)).alias("f"))
    usable = counts.filter("r > 0 and f > 0").withColumn("v", F.sqrt(F.col("r") * F.col("f")))
    q = usable.withColumn("q", F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))).select("category", "q")

    if kind_balance:
        kb = {k: float(kind_balance.get(k, 0.0)) for k in S.KINDS}
        if any(v < 0 for v in kb.values()) or not any(kb.values()):
            raise ValueError(f"shares of kinds can't be below zero or all zero; got {kind_balance}")
        mass = F.lit(0.0)
        for k, v in kb.items():
            mass = F.when(F.col("kind") == k, F.lit(v)).otherwise(mass)
        real_share = kb["real"] / sum(kb.values())
    else:
        mass, real_share = F.lit(1.0), 0.5
    lw = F.when(F.col("label") == 0, real_share).otherwise(1.0 - real_share)
    kinds = per_group.select("label", "category", "kind").distinct().groupBy("label", "category").agg(
        F.sum(mass).alias("kind_mass"), F.count(F.lit(1)).alias("kinds"))
    gw = F.pow(F.col("n").cast("double"), F.lit(gamma)) * F.when(F.col("marked"), F.lit(float(boost))).otherwise(1.0)
    c = (per_group.join(kinds, ["label", "category"]).join(q, "category", "left")
         .withColumn("q", F.coalesce("q", F.lit(0.0))).withColumn("gw", gw)
         .withColumn("cell_gw", F.sum("gw").over(Window.partitionBy("label", "category", "kind"))))
    share = F.when((F.col("kinds") <= 1) | (F.col("kind_mass") <= 0), 1.0).otherwise(mass / F.col("kind_mass"))
    c = c.withColumn("w", lw * F.col("q") * share * F.col("gw") / F.col("cell_gw") / F.col("n"))
    whole = F.sum(F.col("w") * F.col("n")).over(Window.partitionBy(F.lit(1)))
    return c.withColumn("w", F.col("w") / whole).select(*CELL, "n", "q", "w", "marked")


def cap_weights(cells: DataFrame, max_replay: float) -> DataFrame:
    """The closest weights with w <= max_replay / rows: min(lambda w, cap), lambda in closed form.

    Cells of equal weight form a tier. Going down from the heaviest, capping all heavier tiers leaves
    lambda = (1 - cap * rows above) / (1 - mass above); the first tier that then fits under the cap
    decides. The windows run over the cell table, one row per registry group and kind. When even a
    full cap cannot carry the mass, servable rows share it evenly.
    """
    one = Window.partitionBy(F.lit(1))
    c = cells.withColumn("_rows", F.sum("n").over(one)).withColumn(
        "_served", F.sum(F.when(F.col("w") > 0, F.col("n")).otherwise(0)).over(one))
    cap = F.lit(float(max_replay)) / F.col("_rows")
    above = one.orderBy(F.desc("w")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tier = Window.partitionBy("w")
    c = (c.withColumn("_na", F.sum("n").over(above) - F.sum("n").over(tier))
         .withColumn("_ma", F.sum(F.col("w") * F.col("n")).over(above) - F.sum(F.col("w") * F.col("n")).over(tier)))
    lam = (F.lit(1.0) - cap * F.col("_na")) / (F.lit(1.0) - F.when(F.col("_na") == 0, 0.0).otherwise(F.col("_ma")))
    fits = (F.col("w") > 0) & (lam * F.col("w") <= cap * (1 + 1e-12)) & (lam > 0)
    c = c.withColumn("_lam", F.max_by(F.when(fits, lam), F.when(fits, F.col("w"))).over(one))
    even = F.lit(1.0) / F.col("_served")
    capped = F.when(F.col("w") <= 0, 0.0).when(F.col("_lam").isNull() | (F.col("_served") * cap < 1.0), even).otherwise(
        F.least(F.col("_lam") * F.col("w"), cap))
    bound = F.max("w").over(one) > cap
    return (c.withColumn("cap_bound", bound).withColumn("w", F.when(bound, capped).otherwise(F.col("w")))
            .drop("_rows", "_served", "_na", "_ma", "_lam"))


def weigh(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows with their cell's weight."""
    return small_join(rows, cells.select(*CELL, "w"), CELL, "inner")


def one_kind(rows: DataFrame) -> DataFrame:
    """Rows as seen by ``cell_weights`` without a kind level."""
    return rows.withColumn("kind", F.lit("_all_"))


# ---- reports on weights -------------------------------------------------------------------------

def category_balance(cells: DataFrame) -> DataFrame:
    """P(fake | category) under the weights, and how far it is from one half."""
    m = F.col("w") * F.col("n")
    return (cells.filter("q > 0").groupBy("category").agg(
        F.max("q").alias("q"), (F.sum(F.when(F.col("label") == 1, m).otherwise(0.0)) / F.sum(m)).alias("p_fake"))
        .withColumn("off", F.abs(F.col("p_fake") - 0.5) > 1e-6))


def kind_reach(cells: DataFrame, kind_balance: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    """Per kind: requested share, realised share, and the ceiling set by the categories it occupies."""
    total = sum(kind_balance.values())
    target = F.lit(0.0)
    for k, v in kind_balance.items():
        target = F.when(F.col("kind") == k, v / total).otherwise(target)
    side = F.when(F.col("label") == 0, kind_balance["real"] / total).otherwise(1 - kind_balance["real"] / total)
    per = cells.groupBy("kind", "label", "category").agg(F.sum(F.col("w") * F.col("n")).alias("m"), F.max("q").alias("q"))
    k = per.groupBy("kind", "label").agg(F.sum("m").alias("realised"), F.sum("q").alias("qs"))
    k = k.select("kind", target.alias("target"), "realised", (side * F.col("qs")).alias("ceiling"))
    return k.withColumn("status", F.when(F.col("target") > F.col("ceiling") + 1e-9, "unreachable")
                        .when(F.abs(F.col("realised") - F.col("target")) > tolerance, "missed").otherwise("met"))


def sampler_totals(cells: DataFrame) -> DataFrame:
    n, w = F.col("n"), F.col("w")
    s = cells.agg(F.sum(F.when(F.col("label") == 1, w * n).otherwise(0.0)).alias("p_fake"), F.sum("n").alias("rows"),
                  F.sum(F.when(w > 0, n).otherwise(0)).alias("servable"), F.min(F.when(w > 0, w)).alias("_lo"), F.max(w).alias("_hi"))
    return s.select("p_fake", "rows", "servable", (F.col("_lo") * F.col("rows")).alias("amp_min"), (F.col("_hi") * F.col("rows")).alias("amp_max"))


def dataset_replay(weighted: DataFrame, max_replay: float, rows_total: int) -> DataFrame:
    """Per dataset: rows, mass, highest expected draws per row, whether the cap clips it."""
    return (weighted.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("w").alias("mass"), (F.max("w") * rows_total).alias("amp"),
        F.min("kind").alias("kind"), F.min("category").alias("category"))
        .withColumn("at_cap", F.col("amp") >= max_replay - 1e-6))


def batch_kind_weights(rows: DataFrame, batch: str, kind: str) -> DataFrame:
    """Equal total weight for every kind present in a batch, mean 1: rows / (kinds * rows of the kind)."""
    c = rows.groupBy(batch, kind).agg(F.count(F.lit(1)).alias("_n"))
    t = c.groupBy(batch).agg(F.sum("_n").alias("_b"), F.count(F.lit(1)).alias("_k"))
    w = c.join(t, batch).select(batch, kind, (F.col("_b") / (F.col("_k") * F.col("_n"))).alias("kind_weight"))
    return small_join(rows, w, [batch, kind], "inner")


# ---- draws --------------------------------------------------------------------------------------

def numbered_rows(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, image_id, row_no): 0-based hash order inside each cell, spread over slices of the hash."""
    r = rows.select(*keys, "image_id").withColumn("_u", S.stable_fraction(F.col("image_id"), f"{seed}|order"))
    return R.hash_rank(r, keys, "_u", "image_id", "_rk").select(*keys, "image_id", (F.col("_rk") - 1).alias("row_no"))


def weighted_draws(rows: DataFrame, cells: DataFrame, n: int, seed: int, epoch: int, buckets: int = 4096) -> DataFrame:
    """(slot, image_id): n draws with replacement, the same for a seed and epoch on any layout.

    Weights are constant in a cell, so a draw is a cell by weight, then a row number in it. The cell
    comes from an equality join on slices of [0, 1) that each cell's interval covers, the row from an
    equality join on (cell, row number); neither forms pairs that do not match.
    """
    one = Window.partitionBy(F.lit(1)).orderBy(*CELL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    iv = cells.filter("w > 0").withColumn("_m", F.col("w") * F.col("n")).withColumn("_hi", F.round(F.sum("_m").over(one), 12))
    prev = Window.partitionBy(F.lit(1)).orderBy(*CELL)
    iv = iv.withColumn("_lo", F.coalesce(F.lag("_hi").over(prev), F.lit(0.0)))
    last = F.lead("_hi").over(prev).isNull()
    iv = iv.withColumn("_hi", F.when(last, 1.0).otherwise(F.col("_hi")))
    cover = F.sequence(F.floor(F.col("_lo") * buckets), F.least(F.floor(F.col("_hi") * buckets), F.lit(buckets - 1)))
    iv = iv.select(*CELL, "n", "_lo", "_hi", F.explode(cover).alias("_b"))
    slots = rows.sparkSession.range(n).withColumnRenamed("id", "slot")
    key = F.col("slot").cast("string")
    slots = slots.withColumn("_u", S.stable_fraction(key, f"{seed}|{epoch}|cell")).withColumn(
        "_v", S.stable_fraction(key, f"{seed}|{epoch}|row")).withColumn("_b", F.floor(F.col("_u") * buckets))
    hit = slots.join(iv, "_b").filter("_u >= _lo and _u < _hi")
    hit = hit.select("slot", *CELL, F.floor(F.col("_v") * F.col("n")).alias("row_no"))
    return hit.join(numbered_rows(rows, CELL, seed), [*CELL, "row_no"]).select("slot", "image_id")


def pair_draws(rows: DataFrame, n_pairs: int, seed: int, epoch: int) -> DataFrame:
    """(slot, image_id) for slots 0 .. 2 n_pairs - 1: real and fake row of a random mixed unit."""
    c = rows.groupBy("split_unit").agg(F.count(F.when(F.col("label") == 0, 1)).alias("r"),
                                       F.count(F.when(F.col("label") == 1, 1)).alias("f")).filter("r > 0 and f > 0")
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("split_unit")) - 1
    units = c.withColumn("_i", at.cast("bigint"))
    total = c.agg(F.count(F.lit(1))).scalar()
    j = rows.sparkSession.range(n_pairs).withColumnRenamed("id", "pair")
    key = F.col("pair").cast("string")
    j = j.withColumn("_i", S.stable_choice(key, f"{seed}|{epoch}|unit", total)).join(units, "_i")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("label"), F.lit(i).cast("bigint").alias("at"), F.floor(
        S.stable_fraction(key, f"{seed}|{epoch}|side{s}") * F.col(c)).alias("row_no"))
        for s, i, c in ((0, 0, "r"), (1, 1, "f"))]))
    want = j.select("pair", "split_unit", sides.alias("s")).select(
        (F.col("pair") * 2 + F.col("s.at")).alias("slot"), "split_unit", "s.label", "s.row_no")
    keys = ["split_unit", "label"]
    return want.join(numbered_rows(rows, keys, seed), [*keys, "row_no"]).select("slot", "image_id")


def mix_pairs(draws: DataFrame, pairs: DataFrame, n: int, n_pairs: int, seed: int, epoch: int) -> DataFrame:
    """The first slots give way to pairs, then blocks of two are put in hash order."""
    d = draws.filter(F.col("slot") >= 2 * n_pairs).unionByName(pairs).filter(F.col("slot") < n - n % 2)
    blocks = draws.sparkSession.range(n // 2).withColumnRenamed("id", "block").withColumn(
        "_u", S.stable_fraction(F.col("block").cast("string"), f"{seed}|{epoch}|block"))
    order = R.hash_rank(blocks, [], "_u", "block", "_rk").select("block", (F.col("_rk") - 1).alias("_to"))
    return d.withColumn("block", F.floor(F.col("slot") / 2)).join(order, "block").select(
        (F.col("_to") * 2 + F.col("slot") % 2).alias("slot"), "image_id")


def by_rank(draws: DataFrame, world: int) -> DataFrame:
    """Every worker's share of the stream and its place there."""
    return draws.withColumn("rank", (F.col("slot") % world).cast("int")).withColumn("place", F.floor(F.col("slot") / world))


def stream_totals(drawn: DataFrame, rows: DataFrame) -> DataFrame:
    """P(fake), most draws of one row, and share of rows drawn at all."""
    per = drawn.groupBy("image_id").agg(F.count(F.lit(1)).alias("c"))
    j = per.join(rows.select("image_id", "label"), "image_id")
    return j.agg((F.sum(F.col("c") * F.col("label")) / F.sum("c")).alias("p_fake"), F.max("c").alias("max_draws"),
                 F.count(F.lit(1)).alias("distinct_rows"), F.sum("c").alias("draws"))


def stream_shift(drawn: DataFrame, weighted: DataFrame, show: int = 3) -> DataFrame:
    """The datasets whose share as drawn is furthest from the planned share."""
    per = drawn.groupBy("image_id").agg(F.count(F.lit(1)).alias("c"))
    j = weighted.select("image_id", "dataset", "w").join(per, "image_id", "left")
    s = j.groupBy("dataset").agg(F.sum("w").alias("planned"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(F.lit(1)))
    s = s.select("dataset", "planned", (F.col("c") / total).alias("drawn"))
    return s.orderBy(F.desc(F.round(F.abs(F.col("drawn") - F.col("planned")), 9)), "dataset").limit(show)
