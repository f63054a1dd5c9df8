"""Opt-in approximations: sketches kept once per cell and united for any slice without reading rows again.

Distinct counts and quantiles of a manifest are asked for many slices: a split, a dataset, a week and their unions. ``sketch_table``
keeps one row for each cell with mergeable sketches of bounded size, so a slice costs a union of some cells. Estimates are stated with
their bounds; nothing exact in the library reads them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: registers as a power of two, values kept by a quantile sketch, hashes kept by a set sketch as a power of two.
HLL_BITS, KLL_K, THETA_BITS = 14, 400, 13
#: Bounds that hold with a probability of about 0.997 (three standard errors): relative for distinct counts and set sizes, in rank
#: for quantiles; an intersection is bound relative to the union.
DISTINCT_BOUND, RANK_BOUND, SET_BOUND = 3 * 1.04 / 2 ** (HLL_BITS / 2), 0.0125, 3 / 2 ** (THETA_BITS / 2)


def sketch_table(rows: DataFrame, cells: Sequence[str], distinct: Mapping[str, Column] = {}, numbers: Mapping[str, Column] = {},
                 sets: Mapping[str, Column] = {}) -> DataFrame:
    """One row per cell: cells, n, and ``hll_<name>``, ``kll_<name>``, ``theta_<name>`` for the given columns.

    Null values count in no sketch; a null in a cell column is a cell of its own. Tasks sketch their own rows first, so what is shuffled is a
    sketch for each cell and task.
    """
    return rows.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(c.cast("string"), HLL_BITS).alias(f"hll_{k}") for k, c in distinct.items()],
        *[F.kll_sketch_agg_double(c.cast("double"), KLL_K).alias(f"kll_{k}") for k, c in numbers.items()],
        *[F.theta_sketch_agg(c.cast("string"), THETA_BITS).alias(f"theta_{k}") for k, c in sets.items()])


def distinct_estimates(table: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """(by, rows, estimate) of a column's distinct values in each slice, to DISTINCT_BOUND of the true number."""
    return table.groupBy(*by).agg(F.sum("n").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg(f"hll_{name}")).alias("estimate"))


def quantile_estimates(table: DataFrame, by: Sequence[str], name: str, probs: Sequence[float]) -> DataFrame:
    """(by, prob, value): values whose rank in the slice is the asked one to RANK_BOUND. Slices without values are left out."""
    merged = table.groupBy(*by).agg(F.kll_merge_agg_double(f"kll_{name}").alias("_k")).filter(F.kll_sketch_get_n_double("_k") > 0)
    asked = F.array(*[F.lit(float(p)) for p in probs])
    both = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double("_k", asked).alias("value"))
    return merged.select(*by, F.explode(both).alias("s")).select(*by, F.col("s.prob").alias("prob"), F.col("s.value").alias("value"))


def shared_estimates(table: DataFrame, side: Column, by: Sequence[str], name: str) -> DataFrame:
    """(by, left, right, both, either): distinct values of a column on the two sides of each slice, in both and in either; rows whose
    ``side`` is neither 'left' nor 'right' are left out. Numbers hold to SET_BOUND of ``either``."""
    u = table.withColumn("_s", side).groupBy(*by).agg(*[F.theta_union_agg(F.when(F.col("_s") == s, F.col(f"theta_{name}")), THETA_BITS).alias(s) for s in ("left", "right")])
    size = F.theta_sketch_estimate
    return u.select(*by, size("left").alias("left"), size("right").alias("right"), size(F.theta_intersection("left", "right")).alias("both"),
                    size(F.theta_union("left", "right", THETA_BITS)).alias("either"))
