"""Substring deduplication: content-defined chunks, cut where a gear rolling hash says so, compared by digest.

A text is read as its words set apart by single blanks. The gear hash after a word depends on the last 16 bytes only, and a
chunk ends at the first word, FEWEST or more after its begin, where the hash hits, one in ``ONE_IN``, or after MOST words.
An insertion therefore moves the few cuts beside it, and a passage that two texts share is soon cut alike in both. Chunks whose digest occurs
in several documents are repeated; a run of them with ``LEAST_WORDS`` words or more is a repeated passage, which
stays in the first of its documents and goes from the others.

Digests are counted first, once for each document. Only chunks whose digest may be repeated, by a bounded Bloom filter
over the repeated digests, are then shuffled with their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import carried, filter_bits, key_filter, lookup, maybe_in, sliced
from plumbline.session import cut_lineage

ONE_IN, FEWEST, MOST, LEAST_WORDS = 3, 4, 16, 16
PER_ROW, MOST_BITS = 12, 2**31
#: Random value of each byte in the gear hash.
GEAR = np.random.default_rng(3).integers(0, 2**32, 256, np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after every byte, over the last 16: h = 2 h + GEAR[byte], by doubling the window four times."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def chunks(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, words, start, end) of a text's chunks in order; offsets in code points of the original, ends exclusive."""
    w = (text or b"").split()
    if not w:
        return (np.zeros(0, np.int64),) * 4
    line = b" ".join(w)
    data = np.frombuffer(line, np.uint8)
    last = np.append(np.flatnonzero(data == 32), len(data)) - 1  # of each word
    # Blanks inside a word cannot be: split() and the join leave single ones between words only.
    hit = ((gear(data)[last] * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(ONE_IN) == 0
    cuts, at = [], 0
    for e in [*(np.flatnonzero(hit) + 1).tolist(), len(w)]:
        while e - at > MOST:
            at += MOST
            cuts.append(at)
        if e - at >= FEWEST or (e == len(w) and e > at):
            at = e
            cuts.append(at)
    ends = np.array(cuts)
    firsts = np.append(0, ends[:-1])
    begin, stop = np.append(0, last[:-1] + 2)[firsts], last[ends - 1] + 1
    digest = np.array([xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], np.uint64).view(np.int64)
    raw = np.frombuffer(text, np.uint8)
    blank = _BLANK[raw]
    before = np.append(True, blank[:-1])
    after = np.append(blank[1:], True)
    point = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
    start = point[np.flatnonzero(~blank & before)] - 1
    end = point[np.flatnonzero(~blank & after)]
    return digest, ends - firsts, start[firsts], end[ends - 1]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in sliced(batches, "text"):
        own = [np.unique(chunks(t)[0]) for t in texts]
        yield pa.RecordBatch.from_pydict({"digest": pa.array(np.concatenate(own))})


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in sliced(batches, "text"):
        found = [chunks(t) for t in texts]
        many = [len(f[0]) for f in found]
        ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(many)), many)))
        body = np.repeat(np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], np.uint64).view(np.int64), many)
        at = np.concatenate([np.arange(n) for n in many])
        cols = {"id": ids, "body": pa.array(body), "at": pa.array(at.astype(np.int32))}
        for k, name in enumerate(("digest", "words", "start", "end")):
            joined = np.concatenate([f[k] for f in found])
            cols[name] = pa.array(joined if name == "digest" else joined.astype(np.int32))
        yield pa.RecordBatch.from_pydict(cols)


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, body, start, end, words, first_id, own) of every passage that is repeated across documents.

    A document is a key with a text (``body`` is its hash): rows that repeat both are one document, and what is repeated
    only inside one does not count. ``own`` says that the passage stays here. ``first_id`` is the smallest key that
    holds the passage's first chunk; passages are cut where ``own`` changes.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    again = rows.mapInArrow(_digests, "digest long").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    again = cut_lineage(again)
    bits = filter_bits(again.count(), PER_ROW, MOST_BITS, 2)
    places = rows.mapInArrow(_places, "id long, body long, at int, digest long, words int, start int, end int")
    maybe = maybe_in(places, F.col("digest"), key_filter(again, "digest", bits), bits, 2, "maybe").filter("maybe").drop("maybe")
    maybe = cut_lineage(maybe)
    who = F.struct(F.col("id").isNull().alias("none"), "id", "body")
    groups = maybe.groupBy("digest").agg(F.min(who).alias("first"), F.max(who).alias("last")).filter("first < last")
    groups = cut_lineage(groups.select(F.col("digest").alias("d"), F.col("first.id").alias("first_id"), F.col("first.body").alias("first_body")))
    marked = lookup(maybe, groups, F.col("digest") == F.col("d"), "inner").dropDuplicates(["id", "body", "at"])
    own = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("body") == F.col("first_body"))
    doc = Window.partitionBy("id", "body").orderBy("at")
    marked = marked.withColumn("own", own).withColumn("run", F.col("at") - F.row_number().over(doc))
    whole = marked.withColumn("run_words", F.sum("words").over(Window.partitionBy("id", "body", "run"))).filter(F.col("run_words") >= least_words)
    # Parts of a run that stay and parts that go are told apart.
    turn = F.col("at") - F.row_number().over(Window.partitionBy("id", "body", "run", "own").orderBy("at"))
    parts = whole.withColumn("part", turn).groupBy("id", "body", "run", "own", "part")
    return parts.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
                     F.min_by("first_id", "at").alias("first_id")).drop("run", "part")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document that shares a passage with another: key, n_passages, repeated_words, cut_words, passages and
    cuts (start:end by start, comma-joined: all repeated spans, and those that go), first_ids (keys that keep what goes).

    Null and empty texts share nothing. A null key comes after all others, so that its passages go. Rows that repeat key
    and text are one document and one row. Ties in the first place are broken by the text's hash. An empty table
    gives an empty result; other columns are not read.
    """
    span = F.struct("start", "end", "words", "own", "first_id")
    by = repeated_runs(docs, key, text, least_words).groupBy("id", "body").agg(F.array_sort(F.collect_list(span)).alias("s"))
    gone = F.filter("s", lambda x: ~x["own"])
    words = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["words"])
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return by.select(F.col("id").alias(key), F.size("s").cast("long").alias("n_passages"), words(F.col("s")).alias("repeated_words"),
                     words(gone).alias("cut_words"), shown(F.col("s")).alias("passages"), shown(gone).alias("cuts"),
                     F.array_sort(F.array_distinct(F.array_compact(F.transform(gone, lambda x: x["first_id"])))).alias("first_ids"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: s["start"]):
                parts.append(t[at : s["start"]])
                at = s["end"]
            out.append("".join(parts) + t[at:])
        yield pa.RecordBatch.from_pydict({"_row": batch.column("_row"), "text": pa.array(out, pa.string())})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated passages left out of all documents but their first; all rows and columns are kept.

    Rows are shuffled only where the filter says that something of theirs may go.
    """
    runs = repeated_runs(docs, key, text, least_words).filter("not own")
    cuts = cut_lineage(runs.groupBy("id", "body").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    bits = filter_bits(cuts.count(), PER_ROW, MOST_BITS, 2)
    bodies = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = maybe_in(carried(bodies, id=F.col(key).cast("long"), text=F.col(text)), F.col("id"), key_filter(cuts, "id", bits), bits, 2, "maybe")
    hashed = rows.filter("maybe and text is not null").select("_row", "id", "text").mapInArrow(
        _with_body, docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"),
                                F.lit(0).cast("long").alias("body")).schema)
    c = cuts.select(F.col("id").alias("i"), F.col("body").alias("b"), "spans")
    joined = hashed.join(c, F.col("id").eqNullSafe(F.col("i")) & (F.col("body") == F.col("b")), "left")
    cut = joined.filter("spans is not null").select("_row", "text", "spans")
    cut = cut.mapInArrow(_cut, cut.select("_row", "text").schema)
    same = rows.filter("not maybe or text is null").select("_row.*").union(joined.filter("spans is null").select("_row.*"))
    return same.union(cut.select(*[F.col("text").alias(text) if x == text else F.col(f"_row.`{x}`") for x in docs.columns]))


def _with_body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in sliced(batches, "text"):
        body = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body)], names=[*batch.schema.names, "body"])
