"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

The text is read with one blank before it. Tokens are intervals of its bytes. For each batch the starts of one side are looked up
among the starts of the other with ``pandas.merge_asof``, keyed by text: the last token that starts at or before a position
covers it. Two tokens overlap exactly if one of them covers the other's start, so both directions together give all overlaps;
those that end at the same byte are links, and their ends cut both sides into groups.

Both tokenizers cut before a single blank between two other characters (the byte tokenizer's pattern puts the blank before the
word, and no piece of the other has a blank behind another character). Documents are cut there: tokens, groups and links of a
document are those of its pieces, one after the other. A piece that a task has met before isn't encoded and aligned again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SMALL_ROWS, sliced
from plumbline.session import cut_lineage, ensure_checkpoint_dir

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that are aligned at a time, and pieces that a task remembers.
AT_ONCE, REMEMBERED = 1 << 20, 400_000
#: White space other than blanks beside a blank: no cut there.
_WIDE_ENDS = re.compile(r"[^\S ] | [^\S ]")
#: Pairs of ids, 24 bytes each, up to which their counts may be broadcast (some 50 MB).
PAIR_ROWS = 10 * SMALL_ROWS


def _byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable ones stand for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in range(n)]
        self.shown = [str(k) for k in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of each piece on both sides, and whether the joined bytes of both are the piece with a blank before it."""
        whole = [" " + p for p in pieces]
        a = [x.ids for x in self.a.encode_batch_fast(whole, add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        if all(b"".join([table[i] for ids in side for i in ids]) == "".join(whole).encode() for side, table in ((a, self.a_bytes), (b, self.b_bytes))) and self._aligned_ends(whole, a, b):
            return a, b, [True] * len(pieces)
        same = [b"".join(map(self.a_bytes.__getitem__, x)) == (w := p.encode()) and b"".join(map(self.b_bytes.__getitem__, y)) == w
                for p, x, y in zip(whole, a, b, strict=True)]
        return a, b, same

    def _aligned_ends(self, whole: list[str], a: list[list[int]], b: list[list[int]]) -> bool:
        """Whether every piece's tokens have as many bytes as the piece."""
        want = [len(w.encode()) for w in whole]
        return all(np.array_equal(np.diff(np.append(0, np.cumsum(size[np.fromiter((i for ids in side for i in ids), np.int64)]))[np.append(0, np.cumsum([len(x) for x in side]))]), want)
                   for side, size in ((a, self.a_size), (b, self.b_size)))


@lru_cache(1)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of all overlapping tokens, by a's, then b's order. Both sides cover the same bytes of the same
    documents; starts ascend over all documents, as ``merge_asof`` asks for."""
    a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(start_b))})
    over_a = pd.merge_asof(a, b, on="start", by="doc")
    over_b = pd.merge_asof(b, a, on="start", by="doc")
    # Tokens that start together are found from both sides; they are taken from the first.
    extra = start_a[over_b["a"].to_numpy()] != start_b
    x = np.concatenate([over_a["a"].to_numpy(), over_b["a"].to_numpy()[extra]])
    y = np.concatenate([over_a["b"].to_numpy(), over_b["b"].to_numpy()[extra]])
    order = np.lexsort((y, x))
    return x[order], y[order]


def pieces(text: str) -> list[str]:
    """The text cut at single blanks between two other characters; the blank before each piece is the one that both sides add."""
    words = text.split(" ")
    if all(words) and not _WIDE_ENDS.search(text):
        return words
    out, now = [], None
    for p in words:
        if now is None:
            now = p
        elif p and now and not p[0].isspace() and not now[-1].isspace():
            out.append(now)
            now = p
        else:
            now = f"{now} {p}"
    return [*out, now] if text else []


class Known(dict):
    """(tokens of a, tokens of b, groups, linked pairs) of pieces; None where a side doesn't give the piece's bytes."""

    def __init__(self, own: Sides) -> None:
        self.own, self.width = own, len(own.b_bytes)

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 20_000):
            self._align(new[i : i + 20_000])

    def _align(self, some: list[str]) -> None:
        own = self.own
        a, b, same = own.encode(some)
        self.update((p, None) for p, s in zip(some, same, strict=True) if not s)
        texts = [k for k, s in enumerate(same) if s]
        n_a, n_b = (np.array([len(side[k]) for k in texts], np.int64) for side in (a, b))
        ids_a, ids_b = (np.fromiter((i for k in texts for i in side[k]), np.int64, n) for side, n in ((a, n_a.sum()), (b, n_b.sum())))
        end_a, end_b = np.cumsum(own.a_size[ids_a]), np.cumsum(own.b_size[ids_b])
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        x, y = overlaps(text_a, end_a - own.a_size[ids_a], text_b, end_b - own.b_size[ids_b])
        linked = end_a[x] == end_b[y]
        x, y = x[linked], y[linked]
        at = np.searchsorted(text_a[x], np.arange(len(texts) + 1)).tolist()
        pairs = (ids_a[x] * self.width + ids_b[y]).tobytes()
        # Tokens aren't empty, so a group ends with one token of each side: as many groups as links.
        shown_a, shown_b = ([own.shown[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        groups, p, q = [], 0, 0
        for i, j in zip((x + 1).tolist(), (y + 1).tolist(), strict=True):
            groups.append(f"{shown_a[p] if i - p == 1 else ','.join(shown_a[p:i])}|{shown_b[q] if j - q == 1 else ','.join(shown_b[q:j])}")
            p, q = i, j
        for i, k in enumerate(texts):
            lo, hi = at[i], at[i + 1]
            self[some[k]] = (len(a[k]), len(b[k]), ";".join(groups[lo:hi]), pairs[8 * lo : 8 * hi])


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    known = Known(sides(a_path, b_path))
    for batch, texts in sliced(batches, "text"):
        n_bytes = np.array([len(t or b"") for t in texts])
        cuts = np.flatnonzero(np.diff(np.cumsum(n_bytes) // AT_ONCE)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            parts = [pieces((t or b"").decode()) for t in texts[lo:hi]]
            if len(known) > REMEMBERED:
                known.clear()
            known.learn(list({p for own in parts for p in own if p not in known}))
            found = [[known[p] for p in own] for own in parts]
            found = [[] if None in own else own for own in found]
            n_a, n_b, groups, linked = zip(*[tuple(zip(*own, strict=True)) if own else ((),) * 4 for own in found], strict=True)
            linked = [b"".join(p) for p in linked]
            n_links = np.array([len(p) // 8 for p in linked], np.int64)
            # Distinct pairs of each document with how often they occur there.
            pair, doc = np.frombuffer(b"".join(linked), np.int64), np.repeat(np.arange(hi - lo), n_links)
            order = np.lexsort((pair, doc))
            p, d = pair[order], doc[order]
            new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]))) if len(p) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(p)))
            at = np.searchsorted(d[new], np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").slice(lo, hi - lo), "n_a": pa.array(list(map(sum, n_a)), pa.int64()), "n_b": pa.array(list(map(sum, n_b)), pa.int64()), "n_groups": pa.array(n_links), "n_links": pa.array(n_links),
                "groups": pa.array(list(map(";".join, groups)), pa.string()),
                "pairs": pa.ListArray.from_arrays(pa.array(at), pa.array(p[new])),
                "times": pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int64)))})


ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b (tokens), n_groups, n_links, groups (ids of both sides in order, ``a1,a2|b1;a3|b2,b3``),
    pairs (distinct linked ids, a * size of B's vocabulary + b) and times (how often each occurs in the document).

    Null and empty texts, and those whose tokens on either side do not join to a blank and the text, have no tokens: zeros and
    empty groups. Strings of special tokens are plain text. Rows may repeat and ids be null; other columns are not read. The
    tokenizer files are read by every worker from ``folder``, which all machines have.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _aligned(b, f"{folder}/{a_file}", f"{folder}/{b_file}"), ALIGNED)


def pair_counts(found: DataFrame, b_size: int = 32_000) -> DataFrame:
    """(pair, n, best): links of each pair of ids over all documents, and whether no other pair of the same B id has more."""
    counts = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = cut_lineage(counts)
    top = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("most"))  # one row per id of B at most
    return counts.join(F.broadcast(top), F.col("pair") % b_size == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``aligned`` with groups as digest, n_best and count_sum: per row key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts links whose pair occurs as often as any of its B id in all documents, ties included; count_sum adds up
    the pairs' counts over the links. Texts are encoded once; what is needed of them is written to the shared checkpoint
    folder. Counts of up to PAIR_ROWS pairs are broadcast, more are joined by shuffle. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    found = aligned(docs, key, text, folder, a_file, b_file)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/aligned-{uuid.uuid4().hex}"
    found.select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"),
                 "pairs", "times").write.parquet(place)
    kept = spark.read.parquet(place)
    counts = cut_lineage(pair_counts(kept))
    links = kept.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = links.join(F.broadcast(counts) if counts.count() <= PAIR_ROWS else counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return kept.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
