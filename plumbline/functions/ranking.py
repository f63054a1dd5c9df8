"""Ordered computations that stay spread out however large one group is.

A plain ``row_number`` or running sum over ``partition by g`` puts a whole group into one task. Here
a group is first cut into ordered buckets; each bucket is a window partition of its own, and the
offsets come from the small table of bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.lookup import group_key, small_join
from plumbline.session import cut_lineage

COARSE_BUCKETS = 64
#: Least number of parts of a coarse bucket, and rows of a bucket from which there are more.
FINE_BUCKETS, ROWS_PER_BUCKET = 32, 1_000_000


def _with_buckets(df: DataFrame, order: str, shared: bool = False) -> DataFrame:
    """Add ``_b``, a non-decreasing bucket number for ``order``, from approximate quantiles of the table.

    Only balance depends on the quantiles being approximate; the result of any caller does not.
    """
    text = df.schema[order].dataType.simpleString() == "string"
    if text:
        numbered = _with_string_number(df, order, ["_k"])
    else:
        numbered = df.withColumn("_num", F.col(order).cast("double"))
    cuts = [i / COARSE_BUCKETS for i in range(1, COARSE_BUCKETS)]
    used = F.when(F.xxhash64(*df.columns) > F.lit(-(2**63)), F.col("_num")) if shared else F.col("_num")
    seen = numbered.agg(F.struct(F.percentile_approx(used, cuts, F.lit(1000)).alias("at"), F.count(F.lit(1)).alias("n"))).scalar()
    fine_of = F.greatest(F.lit(FINE_BUCKETS), F.ceil(F.col("_seen.n") / F.lit(COARSE_BUCKETS * ROWS_PER_BUCKET)))
    at = numbered.withColumn("_seen", seen).withColumn("_bounds", F.col("_seen.at")).withColumn("_parts", fine_of).withColumn(
        "_at", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_num"))), F.lit(0)))
    ends = at.select("*", F.when(F.col("_at") > 0, F.get("_bounds", F.col("_at") - 1)).alias("_lo"),
                     F.get("_bounds", F.col("_at")).alias("_hi"))
    step = F.floor((F.col("_num") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (F.col("_parts") - 1))
    fine = F.when(F.col("_hi") > F.col("_lo"), F.least(F.greatest(step, F.lit(0)), F.col("_parts") - 1))
    out = ends.select(*df.columns, (F.col("_at") * F.col("_parts") + F.coalesce(fine, F.lit(0))).cast("bigint").alias("_b"))
    return _split_large(out, order) if text else out


def _with_string_number(df: DataFrame, order: str, part: Sequence[str]) -> DataFrame:
    """Add ``_num``: six bytes after the prefix common to all values of a part, read as a number; keeps byte order."""
    ends = df.groupBy(*part).agg(F.min(order).alias("a"), F.max(order).alias("b"))
    n = F.greatest(F.least(F.length("a"), F.length("b")), F.lit(1))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.col("a").substr(i, F.lit(1)) == F.col("b").substr(i, F.lit(1)))
    first_diff = F.array_position(same, F.lit(False))
    start = F.when(first_diff == 0, n + 1).otherwise(first_diff).cast("int")
    r = small_join(df, ends.select(*part, start.alias("_from")), part)
    tail = F.substring(F.hex(F.encode(F.col(order).substr(F.col("_from"), F.lit(6)), "utf-8")), 1, 12)
    return r.withColumn("_num", F.conv(F.rpad(tail, 12, "0"), 16, 10).cast("double")).drop("_from")


def _split_large(df: DataFrame, order: str) -> DataFrame:
    """Cut string buckets of more than ROWS_PER_BUCKET rows again, by the bytes after the prefix that their own values
    share, until none is left; ``_b`` becomes the path of numbers."""
    df = df.withColumn("_b", F.array("_b"))
    while True:
        size = df.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_x"), F.max(order).alias("_y"))
        large = cut_lineage(size.filter((F.col("_n") > ROWS_PER_BUCKET) & (F.col("_x") < F.col("_y"))).select("_k", "_b", "_n"))
        if large.isEmpty():
            return df
        names = [c for c in df.columns if c != "_b"]
        r = small_join(df, large, ["_k", "_b"])
        r = cut_lineage(r)
        inside = _with_string_number(r.filter("_n is not null"), order, ["_k", "_b"])
        ends = inside.groupBy("_k", "_b").agg(F.min("_num").alias("_lo"), F.max("_num").alias("_hi"))
        inside = small_join(inside, ends, ["_k", "_b"])
        parts = F.ceil(4 * F.col("_n") / F.lit(ROWS_PER_BUCKET))
        at = F.floor((F.col("_num") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts)
        inside = inside.select(*names, F.concat("_b", F.array(F.coalesce(at, F.lit(0)).cast("bigint"))).alias("_b"))
        df = r.filter("_n is null").select(*names, "_b").unionByName(inside)


def running_total(df: DataFrame, groups: Sequence[str], order: str, values: Sequence[str],
                  tie: str | None = None, uniform: bool = False, shared: bool = True) -> DataFrame:
    """Add ``<v>_before`` (sum over smaller ``order`` in the group) and ``<v>_all`` (group sum).

    (groups, order, tie) must be unique; aggregate first. Row order is spread over buckets, which for
    a ``uniform`` order on [0, 1) are equal slices. The table is read for its rows, its bucket totals
    and its quantiles; with ``shared`` each reader touches every column, so that none is pruned
    differently and all three reuse the one exchange of the aggregate below.
    """
    groups = list(groups)
    df = df.withColumn("_k", group_key(groups))
    if uniform:
        b = df.withColumn("_b", F.floor(F.col(order) * _default_buckets(df)).cast("bigint"))
    else:
        b = _with_buckets(df, order, shared)
    base = b
    inside = Window.partitionBy("_k", "_b").orderBy(order, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    b = b.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"{v}_before") for v in values])
    totals = base.groupBy("_k", "_b").agg(*[F.sum(v).alias(f"_{v}_t") for v in values],
                                          F.max(F.xxhash64(*df.columns) if shared else F.lit(0)).alias("_h"))
    totals = totals.filter("_h is not null")
    ahead = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_k")
    offsets = totals.select(
        "_k", "_b",
        *[F.coalesce(F.sum(f"_{v}_t").over(ahead), F.lit(0)).alias(f"_{v}_o") for v in values],
        *[F.sum(f"_{v}_t").over(whole).alias(f"{v}_all") for v in values])
    out = b.join(offsets, ["_k", "_b"])
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"{v}_before") + F.col(f"_{v}_o"))
    return out.drop("_k", "_b", *[f"_{v}_o" for v in values])


def hash_rank(df: DataFrame, groups: Sequence[str], fraction: str, tie: str, name: str = "rank",
              buckets: int | None = None) -> DataFrame:
    """1-based rank by (fraction, tie) in each group, plus ``<name>_of`` = the group's size.

    ``fraction`` is uniform on [0, 1), so equal slices of it are equal slices of any group, the
    hottest included.
    """
    groups = list(groups)
    n = buckets or _default_buckets(df)
    b = df.withColumn("_k", group_key(groups)).withColumn("_b", F.floor(F.col(fraction) * n).cast("bigint"))
    inside = Window.partitionBy("_k", "_b").orderBy(fraction, tie)
    ranked = b.withColumn("_r", F.row_number().over(inside))
    counts = b.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_b", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"),
                            F.sum("_n").over(Window.partitionBy("_k")).alias(f"{name}_of"))
    return (ranked.join(offsets, ["_k", "_b"])
            .withColumn(name, F.col("_r") + F.col("_o")).drop("_k", "_b", "_r", "_o"))


def quota_cuts(df: DataFrame, groups: Sequence[str], fraction: str, tie: str, quota: int | DataFrame) -> DataFrame:
    """Where each group's first ``quota`` rows by (fraction, tie) end: (groups, cut_u, cut_tie).

    ``quota`` is one number or a table (groups, _q). Counts per slice of the fraction tell which slice holds the last
    wanted row; only that slice, about ROWS_PER_BUCKET rows of the largest group at most, is ordered. Groups
    within their quota have no cut.
    """
    groups = list(groups)
    slices = F.greatest(F.lit(4096), F.ceil(df.agg(F.count(F.lit(1))).scalar() / F.lit(ROWS_PER_BUCKET)))
    b = df.select(*groups, fraction, tie).withColumn("_b", F.floor(F.col(fraction) * slices).cast("bigint"))
    counts = b.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = small_join(counts, quota, groups, "inner") if isinstance(quota, DataFrame) else counts.withColumn("_q", F.lit(quota))
    key = group_key(groups)
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("_s", F.sum("_n").over(upto)).withColumn("_t", F.sum("_n").over(Window.partitionBy(key)))
    edge = at.filter("_t > _q and _s >= _q and _s - _n < _q").select(*groups, "_b", (F.col("_q") - F.col("_s") + F.col("_n")).alias("_need"))
    near = small_join(b, edge, [*groups, "_b"], "inner")
    inside = Window.partitionBy(key, "_b").orderBy(fraction, tie)
    near = near.withColumn("_r", F.row_number().over(inside)).filter("_r = _need")
    return near.select(*groups, F.col(fraction).alias("cut_u"), F.col(tie).alias("cut_tie"))


def up_to_cut(df: DataFrame, cuts: DataFrame, groups: Sequence[str], fraction: str, tie: str, name: str = "kept") -> DataFrame:
    """Mark the rows up to their group's cut; rows themselves are neither moved nor sorted."""
    u, t = F.col(fraction), F.col(tie)
    inside = F.col("cut_u").isNull() | (u < F.col("cut_u")) | ((u == F.col("cut_u")) & (t <= F.col("cut_tie")))
    return small_join(df, cuts, groups).withColumn(name, inside).drop("cut_u", "cut_tie")


def keep_quota(df: DataFrame, groups: Sequence[str], fraction: str, tie: str, quota: str) -> DataFrame:
    """Mark the first rows of each group as ``kept``, as many as its column ``quota`` says."""
    table = df.groupBy(*groups).agg(F.max(quota).alias("_q"))
    out = up_to_cut(df, quota_cuts(df, groups, fraction, tie, table), groups, fraction, tie)
    return out.withColumn("kept", F.col("kept") & (F.col(quota) > 0))


def ordered_position(df: DataFrame, groups: Sequence[str], order: str, name: str = "position") -> DataFrame:
    """0-based position by a unique ``order`` in each group."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (running_total(one, groups, order, ["_one"], shared=False)
            .withColumnRenamed("_one_before", name).drop("_one", "_one_all"))


def _default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, parts)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group, one column per entry of ``probs``.

    Counts per distinct value first, then picks the values at the two neighbouring positions, so no
    task holds the values of a group.
    """
    groups = list(groups)
    counted = (df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
               .groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")))
    placed = running_total(counted, groups, value, ["n"])
    picks, outs = [], []
    for name, p in probs.items():
        pos = (F.col("n_all") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        frac = (F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))
        outs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name))
    return placed.groupBy(*groups).agg(F.max("n_all").alias("_n"), *picks).select(*groups, *outs)


def rank_auc(df: DataFrame, groups: Sequence[str], score: str, flag: str) -> DataFrame:
    """Tie-aware Mann-Whitney AUC per group with ``n``; NULL where one class is missing."""
    groups = list(groups)
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) \
        & (F.abs(F.col(score).cast("double")) < F.lit(float("inf")))
    counted = df.filter(ok).groupBy(*groups, score).agg(
        F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(flag) == 0, 1).otherwise(0)).alias("neg"))
    placed = running_total(counted, groups, score, ["neg"])
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    sums = placed.groupBy(*groups).agg(pairs.alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    auc = F.when(both, F.col("_u") / (F.col("_p").cast("double") * F.col("_q")))
    return sums.select(*groups, (F.col("_p") + F.col("_q")).alias("n"), auc.alias("auc"))


def folded(auc: Column) -> Column:
    return F.greatest(auc, F.lit(1.0) - auc)


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, name: str, count: str = "n") -> DataFrame:
    """(groups, value) -> average rank over ``count`` copies of each value."""
    groups = list(groups)
    counted = df.groupBy(*groups, value).agg(F.sum(count).alias("_c"))
    placed = running_total(counted, groups, value, ["_c"])
    return placed.select(*groups, value, (F.col("_c_before") + (F.col("_c") + 1) / F.lit(2.0)).alias(name),
                         F.col("_c_all").alias(f"{name}_n"))


def spearman(df: DataFrame, groups: Sequence[str], a: str, b: str) -> DataFrame:
    """Tie-aware Spearman per group with ``n``; NULL below three rows or when a side is constant."""
    groups = list(groups)
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    pairs = df.filter(ok).groupBy(*groups, a, b).agg(F.count(F.lit(1)).alias("n"))
    ranked = (pairs.join(average_ranks(pairs, groups, a, "_ra"), [*groups, a])
              .join(average_ranks(pairs, groups, b, "_rb"), [*groups, b]))
    mid = (F.col("_ra_n") + 1) / F.lit(2.0)
    da, db, n = F.col("_ra") - mid, F.col("_rb") - mid, F.col("n")
    sums = ranked.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.sum(n * da * db).alias("_ab"),
        F.sum(n * da * da).alias("_aa"), F.sum(n * db * db).alias("_bb"))
    fine = (F.col("n") >= 3) & (F.col("_aa") > 0) & (F.col("_bb") > 0)
    rho = F.when(fine, F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    return sums.select(*groups, "n", rho.alias("rho"))


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values of each column as (feature, value, n, place); name breaks ties."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("s")
    counts = df.select(pairs).groupBy("s.feature", "s.value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
