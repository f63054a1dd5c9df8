"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table with one short row per source, rule or sample may be broadcast (some tens of MB).
SMALL_ROWS = 200_000
#: Bits in one bitmap of a filter.
BITMAP = 32_768
#: Bytes of text that a Python worker unpacks at a time, beside the Arrow batch that Spark hands it.
SLICE_BYTES = 4_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ASCII texts take Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def carried(docs: DataFrame, **extra: Column) -> DataFrame:
    """Every column of ``docs`` in one struct ``_row`` beside derived ones, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[c.alias(k) for k, c in extra.items()])


def lookup(rows: DataFrame, table: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a table that is small by nature: broadcast when its counted rows stay below ``SMALL_ROWS``,
    else left to a sort-merge join, whose hot keys Spark splits at run time."""
    return rows.join(F.broadcast(table) if table.count() <= SMALL_ROWS else table, on, how)


def slots(key: Column, bits: int, hashes: int) -> list[Column]:
    """One position per hash function, each in its own equal part of a filter with ``bits`` bits."""
    part = bits // hashes
    return [F.pmod(F.xxhash64(key, F.lit(j)), F.lit(part)) + F.lit(j * part) for j in range(hashes)]


def filter_bits(rows: int, per_row: int, most: int, hashes: int) -> int:
    """Bits of a filter for so many rows: whole bitmaps for each hash function, ``most`` at most."""
    step = BITMAP * hashes
    return max(step, min(most, rows * per_row) // step * step)


def bitmaps(positions: DataFrame, at: str = "slot") -> DataFrame:
    """(block, bitmap): the set bits of a filter, 4 KB for each block of positions that occurs."""
    return positions.groupBy(F.floor(F.col(at) / BITMAP).cast("long").alias("block")).agg(
        F.bitmap_construct_agg(F.col(at) % BITMAP).alias("bitmap"))


def key_filter(keys: DataFrame, key: str, bits: int, hashes: int = 2) -> DataFrame:
    """Bloom filter of a key column as bitmaps; its size is bounded by ``bits`` whatever the number of keys."""
    return cut_lineage(bitmaps(keys.select(F.explode(F.array(*slots(F.col(key), bits, hashes))).alias("slot"))))


def maybe_in(rows: DataFrame, key: Column, table: DataFrame, bits: int, hashes: int, flag: str) -> DataFrame:
    """Add ``flag``: false where the key is surely not in the filter. ``table`` holds bits / 8 bytes at most."""
    seen = F.lit(True)
    for j, slot in enumerate(slots(key, bits, hashes)):
        b, m = f"_block{j}", f"_bitmap{j}"
        rows = rows.withColumn(f"_slot{j}", slot)
        t = F.broadcast(table.select(F.col("block").alias(b), F.col("bitmap").alias(m)))
        rows = rows.join(t, F.floor(F.col(f"_slot{j}") / BITMAP).cast("long") == F.col(b), "left")
        byte = f"conv(hex(substring({m}, cast(_slot{j} % {BITMAP} div 8 + 1 as int), 1)), 16, 10)"
        seen &= F.coalesce(F.expr(f"shiftright(cast({byte} as int), cast(_slot{j} % 8 as int)) & 1 = 1"), F.lit(False))
    drop = [f"_{x}{j}" for j in range(hashes) for x in ("block", "bitmap", "slot")]
    return rows.withColumn(flag, seen).drop(*drop)



def sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the batches with the column's texts as UTF-8, about SLICE_BYTES of them or one text at a time."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        rows = max(1, len(batch) * SLICE_BYTES // max(column.nbytes, 1))
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows), column.slice(i, rows).to_pylist()
