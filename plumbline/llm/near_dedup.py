"""Near-duplicate detection: minhash signatures, a multi-index Hamming join, links confirmed on full shingle sets.

A text's set holds its distinct shingles of ``size`` words, and two sets are alike from a Jaccard similarity of ``share``
percent on; SHINGLE and SHARE are op1's contract. ``CHUNKS`` chunks of ``WIDTH`` 16-bit minhashes make the indexed
signature; distances count minhashes, not bits. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 of them agree, by the pigeonhole principle,
in some chunk but for ERRORS places, so every chunk is indexed once for each choice of places left out: all pairs
within that distance meet under a key. At a similarity of 0.85 two minhashes differ with probability 0.15, and a
pair meets under no key with probability 7e-6; at 0.80 with 2e-4.

Texts with equal sets are one class, and only classes are indexed. Under a key nobody is paired with everybody:
members are compared with one of them, linked classes get a common label, and only keys that still hold several
labels are looked at again, with another member, then with all pairs of different labels. Before two sets are fetched and
compared they pass an exact bound: a set's bitmap holds the parity of its shingles' hashes, and sets differ in at least as
many shingles as their bitmaps differ in bits. That leaves out nearly all pairs of a large group of remoter copies. Texts are
shuffled only where a bounded Bloom filter says that their set may be needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, filter_bits, key_filter, maybe_in, sliced
from plumbline.operators.units import connected_components
from plumbline.session import settle

SHINGLE, SHARE = 3, 85
CHUNKS, WIDTH, ERRORS = 8, 6, 1
HASHES = CHUNKS * WIDTH
#: Bits of a set's bitmap.
PARITY = 1_024
PER_ROW, MOST_BITS = 16, 2**31
#: Rows with a signature, a bitmap or a set in one partition.
WIDE_ROWS = 20_000
_rng = np.random.default_rng(11)
_MUL, _ADD = _rng.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1), _rng.integers(0, 2**32, HASHES, np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of words met before; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, known: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a text in UTF-8; fewer words than ``size`` are one shingle, none are none."""
    w = (text or b"").lower().split()
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))] if w else [], np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    s = h[: len(w) - size + 1]
    for i in range(1, size):
        s = (s ^ (s >> np.uint64(29))) * _P + h[i : len(w) - size + 1 + i]
    s = (s ^ (s >> np.uint64(30))) * _Q
    return np.unique(s ^ (s >> np.uint64(31)))


def minhashes(sets: np.ndarray) -> np.ndarray:
    """HASHES minima, each over another permutation of 32 bits, mixed so that all bits are usable."""
    x, low = (sets >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _MUL + _ADD).min(0), out=low)
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return low ^ (low >> np.uint32(15))


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch, texts in sliced(batches, "text"):
        ids, n, cls, index, bits = batch.column("id"), [], [], [], []
        for t in texts:
            s = shingles(t, known, size)
            n.append(len(s))
            if len(s):
                m = minhashes(s)
                odd = np.bincount((s & np.uint64(PARITY - 1)).view(np.int64), minlength=PARITY) & 1
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                index.append((m & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            else:
                cls.append(None)
                index.append(None)
                bits.append(None)
        yield pa.RecordBatch.from_pydict({"id": ids, "n": pa.array(n, pa.int64()), "cls": pa.array(cls, pa.binary()),
                                          "index": pa.array(index, pa.binary()), "bits": pa.array(bits, pa.list_(pa.int64()))})


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, rep) for each chunk and each choice of the one place left out."""
    for batch, index in sliced(batches, "index"):
        c = np.frombuffer(b"".join(index), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        rep = np.asarray(batch.column("rep"))
        for chunk in range(CHUNKS):
            for out in range(WIDTH):
                k = np.full(len(c), chunk * WIDTH + out + 1, np.uint64)
                for i in range(WIDTH):
                    if i != out:
                        k = (k ^ c[:, chunk, i]) * _P
                        k ^= k >> np.uint64(32)
                yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "rep": pa.array(rep)})


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch, texts in sliced(batches, "text"):
        s = [shingles(t, known, size).view(np.int64) for t in texts]
        yield pa.RecordBatch.from_pydict({"rep": batch.column("id"), "cls": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in s], pa.binary()),
                                          "items": pa.array(s, pa.list_(pa.int64()))})


def near(a: str = "a", b: str = "b", share: int = SHARE) -> Column:
    """Whether two classes may be alike: false only if their sizes or the differing bits of their bitmaps rule it out."""
    apart = F.lit(0)
    for i in range(PARITY // 64):
        apart = apart + F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i]))
    low, high = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (low * 100 >= high * share) & ((low + high) * (100 - share) >= apart * (100 + share))


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of distinct classes whose full sets are alike."""
    x, y = (sets.select(F.col("rep").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    both = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    joined = pairs.join(y, "b").join(x, "a").select("a", "b", both.alias("both"), (F.size("items_a") + F.size("items_b")).alias("sizes"))
    return settle(joined.filter(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * share).select("a", "b"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the keys that still hold several labels."""
    labels = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("label"))
    m = members.select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    m = settle(m)
    mixed = settle(m.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key"))
    return settle(m.join(mixed, "key"))


def _candidates(left: DataFrame, right: DataFrame, known: DataFrame, apart: Column, share: int) -> DataFrame:
    """Distinct pairs of members of one key that pass ``apart`` and ``near``: ``left(key, rep, label)`` with ``right``."""
    x, y = (m.join(known, "rep") for m in (left, right))
    met = x.alias("a").join(y.alias("b"), (F.col("a.key") == F.col("b.key")) & apart & near(share=share))
    return met.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct()


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, n, cls, index, bits) of every row: set size, digest of the set, indexed signature and bitmap."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return settle(rows.mapInArrow(lambda b: _sign(b, size), "id long, n long, cls binary, index binary, bits array<long>"), WIDE_ROWS)


def linked_classes(docs: DataFrame, signed: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                   share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(classes, links): (cls, rep) of every non-empty set, rep its smallest id, and links (a, b) between reps that
    have the same components as all pairs of different sets that are alike. ``signed`` has the same ``size``."""
    whole = signed.filter("id IS NOT NULL AND n > 0").groupBy("cls").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("index").alias("index"), F.first("bits").alias("bits"))
    whole = settle(whole, WIDE_ROWS)
    indexed = whole.select("rep", "index").mapInArrow(_index, "key long, rep long")
    hubs = settle(indexed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "hub"))
    members = settle(indexed.join(hubs, "key"))
    reps = settle(members.select("rep").distinct())
    known = settle(whole.join(reps, "rep", "left_semi").select("rep", "n", "bits"), WIDE_ROWS)
    sets = _needed_sets(docs, reps, key, text, size)

    differ = F.col("a.label") != F.col("b.label")
    first = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    x, y = known.alias("x"), known.alias("y")
    first = first.join(y, F.col("b") == F.col("y.rep")).join(x, F.col("a") == F.col("x.rep")).filter(near("x", "y", share)).select("a", "b")
    links = _confirmed(first, sets, share)
    mixed = _labelled(members, links)
    other = mixed.groupBy("key").agg(F.min_by(F.struct("rep", "label"), F.xxhash64("rep", "key")).alias("h")).select("key", "h.rep", "h.label")
    links = settle(links.union(_confirmed(_candidates(settle(other), mixed, known, differ, share), sets, share)))
    mixed = _labelled(mixed, links)
    links = links.union(_confirmed(_candidates(mixed, mixed, known, F.col("a.label") < F.col("b.label"), share), sets, share))
    return whole.select("cls", "rep"), settle(links)


def _needed_sets(docs: DataFrame, reps: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(rep, items) of the texts with one of these ids; of the others only the few that the filter lets through move."""
    bits = filter_bits(reps.count(), PER_ROW, MOST_BITS, 2)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    maybe = maybe_in(rows, F.col("id"), key_filter(reps, "rep", bits), bits, 2, "maybe").filter("maybe").select("id", "text")
    found = maybe.join(reps, F.col("id") == F.col("rep"), "left_semi").mapInArrow(lambda b: _sets(b, size), "rep long, cls binary, items array<long>")
    return settle(found.groupBy("rep", "cls").agg(F.first("items").alias("items")).filter("size(items) > 0"), WIDE_ROWS)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept. Sets of shingles of ``size`` words are alike from a
    similarity of ``share`` percent on.

    A component is what links connect, and rows that share an id; it is named by its smallest id, whose rows are kept.
    Texts without words have empty sets and are components of their own. A row without id is linked with nothing:
    component_id null, kept. Repeated rows get equal verdicts. An empty table gives an empty result; other columns
    are not read.
    """
    signed = signatures(docs, key, text, size)
    classes, links = linked_classes(docs, signed, key, text, size, share)
    rows = settle(signed.filter("id IS NOT NULL AND n > 0").select("id", "n", "cls").join(classes, "cls").select("id", "n", "rep"))
    twice = settle(rows.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a"))
    again = rows.select("id", F.col("rep").alias("b")).join(twice, "id").filter("a < b").select("a", "b").distinct()
    named = connected_components(links.select("a", "b").union(again), "a", "b").select(F.col("node").alias("rep"), "component")
    linked = rows.join(settle(named), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id",
                                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows without id or words stay.
    All columns are kept. Only rows that may have to go are shuffled."""
    gone = settle(near_groups(docs, key, text, size, share).filter("not kept").select(F.col(key).alias("gone")).distinct())
    bits = filter_bits(gone.count(), PER_ROW, MOST_BITS, 2)
    id = F.col(key).cast("long")
    rows = maybe_in(carried(docs, id=id), F.col("id"), key_filter(gone, "gone", bits), bits, 2, "maybe")
    left = rows.filter("maybe").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return rows.filter("not maybe").select("_row.*").union(left.select("_row.*"))
