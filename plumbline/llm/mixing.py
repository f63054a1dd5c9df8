"""Mixing sources to target weights with histograms over a hash.

Every document has a hash of its key. Sizes are summed by source and hash slice; the slice in which a source's
budget ends is cut into finer slices until single hashes are left, and a document is taken once more when its
hash lies below the source's threshold. No rows are sorted, and budgets are nested: what a smaller share takes
is part of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, carried, lookup
from plumbline.session import cut_lineage

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Bits of the hash that are left below a slice, level by level: 4096 slices, 4096 in the boundary one, then single hashes.
HASH_BITS, LEVELS = 52, (40, 28, 0)


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(key: Column, text: Column) -> Column:
    """52 bits of the key's md5; without a key, of the text's."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("~"), text), F.lit("~"))), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with ``target``.

    Weights go round the sources by code point, null last. A target is min(most * size, level * weight), where
    the level makes the targets add up to share * all sizes: what a full source leaves goes to the others by weight.
    """
    rank = Window.orderBy(F.asc_nulls_last("source"))
    at = (F.row_number().over(rank) - 1) % len(weights)
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * most)
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    full = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    # With the first sources full the level is at least this, and exactly this for the right number of them.
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - full) / left
    t = t.withColumn("level", level)
    top = F.max("level").over(Window.partitionBy())
    return t.withColumn("target", F.least(F.col("most").cast("double"), top * F.col("weight"))).select(
        "source", "source_size", "target")


def thresholds(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, passes, edge, with_edge) from ``rows(source, size, h)``.

    All of a source is taken ``passes`` times, and once more where h < edge, or h = edge if ``with_edge``: the
    edge is taken when that comes nearer to the target. Rows of one hash are taken together.
    """
    slices = cut_lineage(_summed(rows, LEVELS[0]))
    sizes = slices.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = cut_lineage(t.withColumn("passes", passes))
    rest = t.select(F.col("source").alias("s"), (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
                    F.lit(0).cast("long").alias("base"))
    for level, below in enumerate(LEVELS):
        if level:
            prefix = F.shiftright("h", LEVELS[level - 1]) == F.col("slice")
            inside = lookup(rows, rest, F.col("source").eqNullSafe(F.col("s")) & prefix, "inner")
            slices = _summed(inside.select("source", "size", "h"), below)
        joined = lookup(slices, rest.drop("slice"), F.col("source").eqNullSafe(F.col("s")), "inner")
        order = Window.partitionBy("source").orderBy("at")
        upto = joined.withColumn("upto", F.col("base") + F.sum("size").over(order)).filter("upto > rest")
        first = upto.groupBy("source", "rest").agg(F.min(F.struct("at", "upto", "size")).alias("x"))
        rest = cut_lineage(first.select(F.col("source").alias("s"), "rest", F.col("x.at").alias("slice"), "x.upto",
                                        (F.col("x.upto") - F.col("x.size")).alias("base")))
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("base")
    edges = rest.select("s", F.col("slice").alias("edge"), nearer.alias("with_edge"))
    return cut_lineage(t.join(edges, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _summed(rows: DataFrame, below: int) -> DataFrame:
    """Sizes by source and slice; hashes without size cannot be an edge."""
    return rows.groupBy("source", F.shiftright("h", below).alias("at")).agg(F.sum("size").alias("size"))


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows(source, size, h, ...)`` with source_size, target and ``taken``: the words the mix takes, repeats counted."""
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "passes", "edge", "with_edge")
    extra = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("with_edge"))
    return lookup(rows, p, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "taken", F.col("size") * (F.col("passes") + F.coalesce(extra, F.lit(False)).cast("long"))).drop(
        "_s", "passes", "edge", "with_edge", "h")


def mix_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
              weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: key, size, source_size, target, taken; nothing of the texts moves.

    Null texts have size 0, null sources form one source, null keys are hashed by text. Rows that repeat a key
    are taken or left together. An empty table gives an empty result; other columns are not read.
    """
    rows = cut_lineage(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"),
                                   spread(F.col(key), F.col(text)).alias("h")))
    return take(rows, thresholds(rows, weights, share, most)).select(
        F.col("id").alias(key), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``mix_repeats``: how often each is to be read.

    Documents without words have no size and stay out. A column of that name that the table has already gives way to the new
    one. Null sources form one source, null keys are hashed by text, rows that repeat a key are taken together, and an empty table
    gives an empty result. Two scans, one over key, source and size only; rows are
    filtered in place.
    """
    size, h = words_in(F.col(text)), spread(F.col(key), F.col(text))
    rows = cut_lineage(docs.select(F.col(source).alias("source"), size.alias("size"), h.alias("h")))
    plan = thresholds(rows, weights, share, most)
    taken = take(carried(docs, source=F.col(source), size=size, h=h), plan).filter("taken > 0")
    repeats = (F.col("taken") / F.col("size")).cast("long").alias("mix_repeats")
    return taken.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "mix_repeats"], repeats)
