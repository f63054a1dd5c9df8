"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items scans each text once.

A text is normalised to its words, lower-cased and set apart by single spaces. An item's patterns are its windows of
13 consecutive words, or the whole item if it is shorter. The automaton finds all windows in one pass over a text,
whatever their number; found words are mapped back to the original text's characters. Items go into blocks of
``block_chars`` pattern characters, one automaton each, so that a task's memory doesn't grow with the benchmark: with
more than one block the texts are scanned once a block and what was found is united.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, sliced

WINDOW, BLOCK_CHARS = 13, 32_000_000
#: Contaminated: found words are at least one in so many.
ONE_IN = 20
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ORIGINAL = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOUND = "n_words long, hits array<struct<first:int, last:int, start:int, end:int>>, items array<string>"
#: The automaton last used in this process, by block.
_AUTOMATA: dict[str, tuple] = {}


def words(text: str | bytes | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_TABLE).split()


def blocks(benchmark: DataFrame, item: str, text: str, window: int, block_chars: int) -> list[list[tuple[str, list[bytes]]]]:
    """Items that have words, in blocks of about ``block_chars`` characters of patterns."""
    out, size = [], block_chars
    for row in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).toLocalIterator():
        if not (w := words(row[1])):
            continue
        if size >= block_chars:
            out.append([])
            size = 0
        out[-1].append((row[0], w))
        size += len(b" ".join(w)) * min(len(w), window)
    return out or [[]]


def _automaton(token: str, items: list, window: int) -> tuple:
    """(automaton or None, pattern lengths in words, item numbers of each pattern), kept while the process works on a block."""
    if token not in _AUTOMATA:
        _AUTOMATA.clear()
        owners: dict[bytes, set[int]] = {}
        for k, (_, w) in enumerate(items):
            for i in range(max(1, len(w) - window + 1)):
                owners.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(k)
        machine = ahocorasick.Automaton()
        for n, p in enumerate(owners):
            machine.add_word(p.decode("latin-1"), n)
        if owners:
            machine.make_automaton()
        _AUTOMATA[token] = (machine if owners else None, [p.count(b" ") - 1 for p in owners], list(owners.values()))
    return _AUTOMATA[token]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges, both ends included, as the fewest that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(text: bytes | None, machine, lengths: list[int], owners: list[set[int]]) -> tuple[int, list[dict], set[int]]:
    w = words(text)
    if machine is None or not w:
        return len(w), [], set()
    line = b" " + b" ".join(w) + b" "
    found = list(machine.iter(line.decode("latin-1")))
    if not found:
        return len(w), [], set()
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    last = np.searchsorted(gaps, [end for end, _ in found]) - 1
    ranges = _united(list({(int(e) - lengths[n] + 1, int(e)) for e, (_, n) in zip(last, found, strict=True)}))
    at = [m.span() for m in _ORIGINAL.finditer(text.decode())]
    hits = [{"first": a, "last": b, "start": at[a][0], "end": at[b][1]} for a, b in ranges]
    return len(w), hits, set().union(*(owners[n] for n in {n for _, n in found}))


def _scanner(items: list, window: int, name: str):
    token = uuid.uuid4().hex
    ids = [i for i, _ in items]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(token, items, window)
        for batch, texts in sliced(batches, name):
            rows = [_scan(t, *machine) for t in texts]
            cols = {c: batch.column(c) for c in batch.schema.names if c != name}
            cols |= {"n_words": pa.array([r[0] for r in rows], pa.int64()),
                     "hits": pa.array([r[1] for r in rows], pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))),
                     "items": pa.array([sorted({ids[k] for k in r[2]}) for r in rows], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(cols)
    return scan


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of several blocks as the fewest ranges, items once each."""
    for batch in batches:
        hits = []
        for row in batch.column("hits").to_pylist():
            start, end = {h["first"]: h["start"] for h in row}, {h["last"]: h["end"] for h in row}
            hits.append([{"first": a, "last": b, "start": start[a], "end": end[b]} for a, b in _united([(h["first"], h["last"]) for h in row])])
        cols = {c: batch.column(c) for c in batch.schema.names}
        cols["hits"] = pa.array(hits, batch.column("hits").type)
        cols["items"] = pa.array([sorted(set(x)) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_pydict(cols)


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: key, n_words, hits (found word ranges with their characters in the original
    text, end exclusive), items (ids whose windows occur, sorted as strings), n_hit, contaminated.

    Null and empty texts have no words and are clean. Items without words match nothing; an item without id is
    named by the empty string; rows that repeat an id count as one item. With an empty benchmark all is clean, with an
    empty table of texts the result is empty. Other columns are not read.
    """
    parts = blocks(benchmark, item, item_text, window, block_chars)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    if len(parts) == 1:
        found = rows.mapInArrow(_scanner(parts[0], window, "text"), f"id {kind}, {_FOUND}")
    else:  # a row is known by its key and digest; rows that share both find the same in every block
        rows = rows.withColumn("sha", F.sha2("text", 256))
        each = [rows.mapInArrow(_scanner(p, window, "text"), f"id {kind}, sha string, {_FOUND}") for p in parts]
        more = [e.filter("size(hits) > 0").distinct() for e in each]
        both = more[0]
        for m in more[1:]:
            both = both.unionByName(m)
        both = both.groupBy(F.col("id").alias("i"), F.col("sha").alias("s")).agg(
            F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
        both = both.mapInArrow(_unite, f"i {kind}, s string, " + _FOUND.split(", ", 1)[1])
        same = F.col("id").eqNullSafe(F.col("i")) & F.col("sha").eqNullSafe(F.col("s"))
        found = each[0].drop("hits", "items").join(both, same, "left").select(
            "id", "n_words", F.coalesce("hits", F.from_json(F.lit("[]"), both.schema["hits"].dataType)).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    found = found.withColumn("n_hit", n_hit)
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))
    return found.select(F.col("id").alias(key), "n_words", "hits", "items", "n_hit", bad.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without contaminated rows; nulls and empty tables as in ``scan``. All columns are kept.

    With one block, rows are judged where they are read and nothing is shuffled.
    """
    parts = blocks(benchmark, item, item_text, window, block_chars)
    if len(parts) > 1:
        rows = carried(docs, id=F.struct(F.col(key).alias("k"), F.sha2(F.col(text), 256).alias("s")), text=F.col(text))
        bad = scan(rows.select("id", "text"), benchmark, "id", "text", item, item_text, window, block_chars).filter("contaminated")
        bad = bad.select(F.col("id").alias("bad")).distinct()
        return rows.join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("_row.*")
    token, items = uuid.uuid4().hex, parts[0]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(token, items, window)
        for batch, texts in sliced(batches, text):
            keep = []
            for t in texts:
                n, hits, _ = _scan(t, *machine)
                n_hit = sum(h["last"] - h["first"] + 1 for h in hits)
                keep.append(not n_hit or n_hit * ONE_IN < n)
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(clean, docs.schema)
