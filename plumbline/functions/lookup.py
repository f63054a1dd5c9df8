"""Joins with tables that are few rows by nature: one per dataset, class, cell or rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Rows of a short row each, some tens of MB, that may be broadcast.
SMALL_ROWS = 200_000


def group_key(groups: Sequence[str], prefix: str = "") -> Column:
    """The group columns as one value; NULL equals NULL inside it."""
    return F.struct(*[F.col(f"{prefix}{g}") for g in groups]) if groups else F.lit(0)


def small_join(rows: DataFrame, table: DataFrame, groups: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row per group; NULL keys match NULL.

    The table is computed once and counted. Up to SMALL_ROWS it is broadcast and ``rows`` are not moved at all; beyond
    that the join shuffles and Spark splits its hot keys at run time.
    """
    t = cut_lineage(table.withColumn("_key", group_key(groups)).drop(*groups))
    t = F.broadcast(t) if t.count() <= SMALL_ROWS else t
    return rows.withColumn("_key", group_key(groups)).join(t, "_key", how).drop("_key")
