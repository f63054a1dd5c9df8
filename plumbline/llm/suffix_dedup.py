"""Suffix-array deduplication: every byte that lies in a string of ``LENGTH`` bytes which starts anywhere else goes.

Strings of LENGTH bytes that are equal have the same least hash of their ``GRAM``-byte parts, so that hash says which shard a string
belongs to: a text falls into segments, the longest stretches whose strings have one least hash, and segments overlap by
LENGTH - 1 bytes, so that no string is cut. Segments whose hash occurs once hold nothing that repeats and stay where they are
(counts before the shuffle, a bounded Bloom filter after); equal segments travel as one with their number. A shard's segments
are written behind one another and all their suffixes sorted by external induced sorting (``induced``), which carries common
prefixes along: a string repeats if its suffix shares LENGTH bytes with a neighbour, or its segment stands for several.

A hash that a thousandth of all segments or more have is refined: strings that have it are dealt by further hashes of
their parts, with other multipliers. There are a thousand such hashes at most, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import induced
from plumbline.llm.common import SMALL_ROWS, carried, filter_bits, key_filter, maybe_in, sliced
from plumbline.session import cut_lineage

#: Bytes of a repeated string, of the parts that are hashed (a power of two), of text handled at a time, of a block that is sorted.
LENGTH, GRAM, AT_ONCE, BLOCK = induced.CAP, 64, 1 << 19, 2 << 20
PER_ROW, MOST_BITS = 12, 2**31
#: A hash is refined if so many segments have it, and one in so many of all.
HOT_ROWS, HOT_SHARE = 4_096, 1_000
#: Stands between texts and segments; no byte of UTF-8.
GAP = b"\xff"
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = x * seed
    return x ^ (x >> np.uint64(31))


def _grams(data: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling from eight."""
    h = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))).view("<u8")[:, 0]
    h, size = _mixed(h, seed), 8
    while size < GRAM:
        h = _mixed(h[:-size] + (h[size:] << np.uint64(1)) + np.uint64(size), seed)
        size *= 2
    return h


def _least_hash(data: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of one part of the LENGTH bytes from each position on: the first with the least upper half."""
    h, width = _grams(data, seed), LENGTH - GRAM + 1
    n = len(h)
    x = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    x[:n] = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(n, dtype=np.uint64)
    x = x.reshape(-1, width)
    before = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[: n - width + 1], before[width - 1 : n]) & np.uint64(0xFFFFFFFF)).view(np.int64)
    return h[place], place


def segments(texts: list[bytes], hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, start, end, key, refined, inner) of all segments, ends exclusive; texts shorter than LENGTH have none.
    Strings whose least hash is in ``hot`` are dealt by further hashes as well. Without ``inner`` no string of a segment
    repeats inside it, for equal strings have the least hash at different places."""
    size = np.array([len(t) for t in texts], np.int64)
    if size.max(initial=0) < LENGTH:
        return (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, bool),) * 2)
    begin = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(GAP.join([*texts, b""]), np.uint8)
    key, place = _least_hash(data, _SEEDS[0])
    key = key.view(np.int64)
    # A string lies in one text if it starts LENGTH bytes or more before the text's end.
    long = size >= LENGTH
    edge = np.zeros(len(key) + 1, np.int32)
    edge[begin[long]] += 1
    edge[(begin + size - LENGTH + 1)[long]] -= 1
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]) | (edge[:-1] != 0))
    last = np.append(first[1:], len(key))
    own = (np.cumsum(edge[:-1]) > 0)[first]
    first, last = first[own], last[own]
    inner, value = place[first] != place[last - 1], key[first]
    refined = np.zeros(len(first), bool)
    if hot is not None and len(hot):
        refined = hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value
    if refined.any():
        f, z, k = _refined(data, first[refined], last[refined], value[refined])
        first, last, value = (np.append(x[~refined], y) for x, y in ((first, f), (last, z), (value, k)))
        inner = np.append(inner[~refined], np.ones(len(f), bool))
        refined = np.append(refined[~refined], np.ones(len(f), bool))
    text = np.searchsorted(begin, first, "right") - 1
    return text, first - begin[text], last - begin[text] + LENGTH - 1, value, refined, inner


def _refined(data: np.ndarray, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, key) of segments cut anew by the hashes of the other seeds; only their own bytes are hashed."""
    bodies = [data[a : z + LENGTH - 1].tobytes() for a, z in zip(first.tolist(), last.tolist(), strict=True)]
    part = np.frombuffer(GAP.join([*bodies, b""]), np.uint8)
    strings = last - first
    begin = np.cumsum(strings + LENGTH) - strings - LENGTH
    at = np.repeat(begin - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())
    own = np.repeat(np.arange(len(first)), strings)
    key = np.repeat(value, strings).view(np.uint64)
    for seed in _SEEDS[1:]:
        key = _mixed(key ^ _least_hash(part, seed)[0][at], _SEEDS[0])
    key = key.view(np.int64)
    turn = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
    end = np.append(turn[1:], len(key))
    shift = first[own[turn]] - begin[own[turn]]
    return at[turn] + shift, at[end - 1] + 1 + shift, key[turn]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about AT_ONCE bytes of text, or one text."""
    for batch, texts in sliced(batches, "text"):
        at, total = 0, 0
        for k, t in enumerate(texts):
            total += len(t or b"") + 1
            if total > AT_ONCE or k + 1 == len(texts):
                yield batch.slice(at, k + 1 - at), [x or b"" for x in texts[at : k + 1]]
                at, total = k + 1, 0


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _pieces(batches):
        *_, key, _, inner = segments(texts)
        found, at = np.unique(key, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"key": pa.array(found), "n": pa.array(np.bincount(at, 1 + inner, len(found)).astype(np.int64))})


def _segments(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, texts in _pieces(batches):
        text, start, end, key, refined, inner = segments(texts, hot)
        body = [texts[k][a:z] for k, a, z in zip(text.tolist(), start.tolist(), end.tolist(), strict=True)]
        rows = pa.array(text)
        yield pa.RecordBatch.from_pydict({"b1": batch.column("b1").take(rows), "b2": batch.column("b2").take(rows), "start": pa.array(start),
                                          "key": pa.array(key), "refined": pa.array(refined), "inner": pa.array(inner), "body": pa.array(body, pa.binary())})


def _covered(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """Spans that strings of LENGTH bytes at these ascending places cover."""
    turn = np.flatnonzero(starts[1:] - starts[:-1] > LENGTH)
    return starts[np.append(0, turn + 1)].tolist(), (starts[np.append(turn, len(starts) - 1)] + LENGTH).tolist()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each distinct segment of a shard that repeat; rows come ordered by key."""
    kept: list[tuple[bytes, int]] = []
    whole: list[bytes] = []
    group: list[tuple[bytes, int, bool]] = []
    total, last = 0, None

    def close() -> None:
        """A group of one segment needs no neighbours, unless its strings may repeat inside it."""
        nonlocal total
        if len(group) == 1 and not group[0][2]:
            if group[0][1] > 1:
                whole.append(group[0][0])
        else:
            kept.extend((b, n) for b, n, _ in group)
            total += sum(len(b) + 1 for b, *_ in group)
        group.clear()

    for batch in batches:
        for key, body, n, inner in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "n", "inner")), strict=True):
            if key != last:
                close()
                if total >= BLOCK:
                    yield _block(kept, whole)
                    kept, whole, total = [], [], 0
            last = key
            group.append((body, n, inner))
    close()
    yield _block(kept, whole)


def _block(kept: list[tuple[bytes, int]], whole: list[bytes]) -> pa.RecordBatch:
    bodies, froms, tos = list(whole), [[0] for _ in whole], [[len(b)] for b in whole]
    if kept:
        size = np.array([len(b) for b, _ in kept], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        text = np.frombuffer(GAP.join([*(b for b, _ in kept), b""]), np.uint8)
        order, common = induced.sort(text, 256, True)
        again = np.zeros(len(text), bool)
        for lo in range(0, len(order), induced.STEP):
            hi = min(lo + induced.STEP, len(order))
            again[order[lo:hi]] = np.maximum(common[lo:hi], common[lo + 1 : hi + 1]) >= LENGTH
        for (b, n), at in zip(kept, begin.tolist(), strict=True):
            strings = len(b) - LENGTH + 1
            starts = np.arange(strings) if n > 1 else np.flatnonzero(again[at : at + strings])
            if len(starts):
                a, z = _covered(starts)
                bodies.append(b)
                froms.append(a)
                tos.append(z)
    return pa.RecordBatch.from_pydict({"body": pa.array(bodies, pa.binary()), "a": pa.array(froms, pa.list_(pa.int64())), "z": pa.array(tos, pa.list_(pa.int64()))})


def _two(value: Column, a: str, b: str) -> list[Column]:
    """128 bits of a value as two columns, under two seeds."""
    return [F.xxhash64(F.lit(1), value).alias(a), F.xxhash64(F.lit(2), value).alias(b)]


def _bytes(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(b1, b2, spans) of every text that has repeated strings of LENGTH bytes: the text's hash and the sorted spans (a, z) of its segments
    that such strings cover, in bytes; spans may touch or overlap. Copies of a text count as texts, and as one row."""
    value = _bytes(docs, text)
    rows = docs.select(*_two(value, "b1", "b2"), value.alias("text"))
    counts = rows.select("text").mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = cut_lineage(counts)
    repeated, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most HOT_SHARE keys have so large a part of all.
    hot = [r.key for r in counts.filter(F.col("n") >= max(HOT_ROWS, total // HOT_SHARE)).collect()]
    hot = np.sort(np.array(hot, np.int64))
    bits = filter_bits(repeated, PER_ROW, MOST_BITS, 2)
    cut = rows.mapInArrow(lambda b: _segments(b, hot), "b1 long, b2 long, start long, key long, refined boolean, inner boolean, body binary")
    found = maybe_in(cut, F.col("key"), key_filter(counts.select("key"), "key", bits), bits, 2, "maybe").filter("maybe or refined")
    found = cut_lineage(found.select("b1", "b2", "start", "key", "inner", "body"))
    distinct = found.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"))
    sorted_ = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "body binary, a array<long>, z array<long>")
    spans = cut_lineage(sorted_.select(*_two(F.col("body"), "c1", "c2"), "a", "z"))
    places = found.select("b1", "b2", "start", *_two(F.col("body"), "c1", "c2")).groupBy("b1", "b2", "start").agg(F.first("c1").alias("c1"), F.first("c2").alias("c2"))
    met = places.join(_small(spans, F.size("a")), ["c1", "c2"])
    each = met.select("b1", "b2", "start", F.explode(F.arrays_zip("a", "z")).alias("s"))
    return each.groupBy("b1", "b2").agg(F.array_sort(F.collect_list(F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.z")).alias("z")))).alias("spans"))


def _small(table: DataFrame, spans: Column) -> DataFrame:
    """A table with spans, to be broadcast if it has few rows and few spans (some tens of MB)."""
    rows, all_spans = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(spans), F.lit(0))).first()
    return F.broadcast(table) if rows + all_spans <= 2 * SMALL_ROWS else table


def _kept(text: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and what is left."""
    runs: list[list[int]] = []
    for s in spans or ():
        if runs and s["a"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s["z"])
        else:
            runs.append([s["a"], s["z"]])
    parts, at = [], 0
    for a, z in runs:
        parts.append(text[at:a])
        at = z
    return runs, b"".join([*parts, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, list, bytes]]:
    """Each row with its text, removed runs and what is left; texts may be long."""
    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1)
            text = row.column("text")[0].as_py()
            yield row, text, *_kept(text, row.column("spans")[0].as_py())


def _with_spans(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(..., b1, b2, text)`` that surely have no spans, and the others with theirs, or null. Only the others are moved."""
    bits = filter_bits(found.count(), PER_ROW, MOST_BITS, 2)
    rows = maybe_in(rows, F.col("b1"), key_filter(found.select("b1"), "b1", bits), bits, 2, "maybe")
    spans = _small(found.select(F.col("b1").alias("x1"), F.col("b2").alias("x2"), "spans"), F.size("spans"))
    some = rows.filter("maybe").join(spans, (F.col("b1") == F.col("x1")) & (F.col("b2") == F.col("x2")), "left")
    return rows.filter("NOT maybe"), some.drop("x1", "x2")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, runs (start, end of what is removed, in bytes).

    A byte is removed if a string of LENGTH bytes over it starts anywhere else as well, in the same text or another, a copy
    included; overlaps count, and strings are judged on the input. Null texts are empty; texts shorter than LENGTH bytes
    lose nothing. Rows may repeat and keys be null; an empty table gives an empty result; other columns are not read.
    """
    found = cut_lineage(repeated_spans(docs, text))
    value = _bytes(docs, text)
    rows, some = _with_spans(docs.select(F.col(key).alias("id"), *_two(value, "b1", "b2"), value.alias("text")), found)
    none = F.lit(0).cast("long")
    same = rows.select("id", F.length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"),
                       F.array().cast("array<struct<start:long,end:long>>").alias("runs"))
    return same.union(some.select("id", "text", "spans").mapInArrow(_digests, same.schema)).withColumnRenamed("id", key)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for _, text, runs, left in _cut(iter([batch])):
            found.append((len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"start": a, "end": z} for a, z in runs]))
        n_bytes, n_removed, n_spans, sha, runs = zip(*found, strict=True) if found else ((),) * 5
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                                          "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "runs": pa.array(runs, _RUNS)})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, _, runs, left in _cut(batches):
        yield pa.RecordBatch.from_pydict({"_row": row.column("_row"), "text": pa.array([left.decode(errors="ignore")]), "cut": pa.array([bool(runs)])})


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without repeated bytes; all rows and columns stay, null texts too. Bytes of a code point that a removed run cuts in two go
    with the run."""
    found = cut_lineage(repeated_spans(docs, text))
    value = _bytes(docs, text)
    (b1, b2) = _two(value, "b1", "b2")
    rows, some = _with_spans(carried(docs, b1=b1, b2=b2, text=value), found)
    some = some.select("_row", "text", "spans")
    cut = some.mapInArrow(_texts, some.select("_row", F.col("text").cast("string"), F.lit(True).alias("cut")).schema)
    own = F.when(F.col("cut"), F.col("text")).otherwise(F.col(f"_row.`{text}`")).alias(text)
    return rows.select("_row.*").union(cut.select(*[own if c == text else F.col(f"_row.`{c}`") for c in docs.columns]))
