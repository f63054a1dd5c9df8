"""Exact deduplication in two passes over a Bloom filter.

Pass one counts the positions that text digests hit and keeps those hit more than once. Pass two tests every
row against them: a row with a position of its own is surely single and passes straight through, the others
are grouped by digest. Nothing is missed, because copies share all their positions; a single row that is
flagged by chance is grouped alone. The filter has ``per_row`` bits for each row and ``most_bits`` in all, which
bounds what is broadcast; with more rows than that it lets more single rows into the shuffle, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, bitmaps, carried, filter_bits, lookup, maybe_in, slots
from plumbline.session import cut_lineage

PER_ROW, MOST_BITS, HASHES = 16, 2**31, 2


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 after lower-casing A-Z only; null counts as empty. Lowercase hex."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def repeated_positions(digests: DataFrame, bits: int, hashes: int = HASHES) -> DataFrame:
    """Pass one: bitmaps of the positions that more than one row hits. ``digests(sha)``"""
    hit = digests.select(F.explode(F.array(*slots(F.col("sha"), bits, hashes))).alias("slot"))
    return cut_lineage(bitmaps(hit.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")))


def flag_possible(rows: DataFrame, digests: DataFrame, per_row: int, most_bits: int) -> DataFrame:
    """Pass two: ``rows(sha, ...)`` with ``possible``, false for digests that occur once among ``digests(sha)``."""
    bits = filter_bits(digests.count(), per_row, most_bits, HASHES)
    return maybe_in(rows, F.col("sha"), repeated_positions(digests, bits), bits, HASHES, "possible")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 per_row: int = PER_ROW, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest key stays. Null and empty texts form one group. A null key loses to any other;
    a group of null keys has keep_id null and is kept. Rows that repeat both key and text get equal verdicts.
    An empty table gives an empty result; other columns are not read.
    """
    rows = cut_lineage(docs.select(F.col(key).alias("id"), F.unhex(text_digest(F.col(text))).alias("sha")))
    flagged = flag_possible(rows, rows.select("sha"), per_row, most_bits)
    again = flagged.filter("possible").drop("possible")
    groups = again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut_lineage(groups.withColumnRenamed("sha", "group_sha"))
    repeated = lookup(again, groups, F.col("sha") == F.col("group_sha")).select("id", "keep_id", "group_size", "sha")
    single = flagged.filter("not possible").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long"), "sha")
    return repeated.union(single).select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                per_row: int = PER_ROW, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest key.

    Only rows that may be repeated are shuffled, by digest and key together, so that a large group spreads out.
    Rows that repeat both key and text leave one row; nulls as in ``exact_groups``. All columns are kept.
    """
    narrow = cut_lineage(docs.select(F.unhex(text_digest(F.col(text))).alias("sha")))
    rows = carried(docs, sha=F.unhex(text_digest(F.col(text))), id=F.col(key))
    flagged = flag_possible(rows, narrow, per_row, most_bits)
    again = flagged.filter("possible")
    best = again.groupBy("sha").agg(F.max("id").alias("best")).withColumnRenamed("sha", "best_sha")
    winners = again.join(best, (F.col("sha") == F.col("best_sha")) & F.col("id").eqNullSafe(F.col("best")))
    one = winners.groupBy("sha").agg(F.first("_row").alias("_row")).select("_row.*")
    return flagged.filter("not possible").select("_row.*").union(one)
