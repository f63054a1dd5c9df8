"""Toxicity score: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram is a run of 4 to 8 bytes of the lower-cased text inside one word and the blanks around it, hashed into
2**18 buckets and noted as present or absent. A bucket's feature is its log-count ratio between toxic and other
training texts; logistic regression over the buckets that tell the classes apart gives their weights.

Training uses ``sample`` labelled texts (expected number, chosen by hash; all of them where there are fewer), which
bounds what is broadcast and what the fit holds. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import sliced
from plumbline.session import cut_lineage

LENGTHS, BITS = (4, 8), 18
SAMPLE, FEATURES, RIDGE, STEPS = 20_000, 4_096, 1.0, 150
THRESHOLD = 0.3


@dataclass
class Model:
    """Weight of each bucket (mostly 0) and the intercept."""
    weights: np.ndarray
    bias: float
    lengths: tuple[int, int] = LENGTHS
    bits: int = BITS


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text leaves 2 when divided by 4; false without a key."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, key: str, label: str, sample: int | None = None) -> DataFrame:
    """(id, y) of labelled keys that are not held out, the larger label where a key has several.

    With ``sample``, about so many of them by hash, or all if there are fewer.
    """
    rows = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    rows = rows.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    if sample is not None and (n := rows.count()) > sample:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(sample / n * (1 << 40)))
    return rows


def buckets(text: bytes | None, lengths: tuple[int, int], bits: int) -> np.ndarray:
    """Buckets of a text's n-grams, with repeats."""
    line = b" " + b" ".join((text or b"").lower().split()) + b" "
    a = np.frombuffer(line, np.uint8).astype(np.uint32)
    blanks = np.cumsum(a == 32)
    h, out, power = a.copy(), [], np.uint32(1)
    for n in range(2, lengths[1] + 1):
        if len(a) < n:
            break
        power = np.uint32(int(power) * 0x01000193 % 2**32)
        h = h[:-1] + a[n - 1 :] * power
        if n >= lengths[0]:  # blanks may stand first and last only
            inner = blanks[n - 2 :][: len(h)] == blanks[: len(h)]
            x = h[inner] ^ np.uint32(n * 0x9E3779B1 % 2**32)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((x ^ (x >> np.uint32(13))) & np.uint32(2**bits - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counter(lengths: tuple[int, int], bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2**bits), np.int64)
        for batch, texts in sliced(batches, "text"):
            for t, y in zip(texts, batch.column("y").to_pylist(), strict=True):
                n[int(y > 0), np.unique(buckets(t, lengths, bits))] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "clean": pa.array(n[0, at]), "toxic": pa.array(n[1, at])})
    return count


def _chosen(lengths: tuple[int, int], bits: int, order: np.ndarray):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            rows = []
            for t in texts:
                at = order[buckets(t, lengths, bits)]
                rows.append(np.unique(at[at >= 0]))
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "at": pa.array(rows, pa.list_(pa.int32()))})
    return features


def _logistic(counts: np.ndarray, col: np.ndarray, y: np.ndarray, r: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and intercept: accelerated gradient descent with a step from the largest curvature.
    ``counts`` features a row, ``col`` their numbers, row after row."""
    rows = y
    row = np.repeat(np.arange(len(rows)), counts)
    x = r[col]
    v = np.ones(len(r))
    for _ in range(20):  # power iteration for the largest curvature
        v = np.bincount(col, x * np.bincount(row, x * v[col], len(rows))[row], len(r))
        size = np.linalg.norm(v) or 1.0
        v /= size
    rate = 1 / (0.25 * (1.1 * size + len(rows)) + ridge)
    rate_b = rate
    w, b = np.zeros(len(r)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], len(rows)) + b, -40, 40)))
        nw, nb = w - rate * (np.bincount(col, x * (p - y)[row], len(r)) + ridge * w), b - rate_b * (p - y).sum()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, b = nw + (t - 1) / s * (nw - pw), nb + (t - 1) / s * (nb - pb)
        pw, pb, t = nw, nb, s
    return pw, pb


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
        features: int = FEATURES, ridge: float = RIDGE, steps: int = STEPS, lengths: tuple[int, int] = LENGTHS, bits: int = BITS) -> Model:
    """A model from labelled texts that are not held out; without both classes it answers with the labels' mean,
    and with 0.5 without labels."""
    ids = training_labels(labels, key, label, sample)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("y", "text")
    texts = cut_lineage(texts.repartition(16))
    n = {bool(row[0]): row[1] for row in texts.groupBy(F.col("y") > 0).count().collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    none = Model(np.zeros(2**bits, np.float32), float(np.log((toxic + 0.5) / (clean + 0.5))), lengths, bits)
    if not toxic or not clean:
        return none
    counts = texts.mapInArrow(_counter(lengths, bits), "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    p, q = (F.col("toxic") + 0.5) / (toxic + 1.0), (F.col("clean") + 0.5) / (clean + 1.0)
    ratio = F.log(p / q)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.select("bucket", ratio.alias("r"), F.abs(ratio / error).alias("z")).orderBy(F.desc("z"), "bucket").limit(features)
    best = best.collect()
    order = np.full(2**bits, -1, np.int32)
    order[[row["bucket"] for row in best]] = np.arange(len(best))
    got = texts.mapInArrow(_chosen(lengths, bits, order), "y double, at array<int>").toArrow()
    at, y = got["at"].combine_chunks(), np.asarray(got["y"]) > 0
    r = np.array([row["r"] for row in best])
    w, b = _logistic(np.diff(np.asarray(at.offsets)), np.asarray(at.flatten()), y, r, ridge, steps)
    none.weights[[row["bucket"] for row in best]] = w * r
    return Model(none.weights, b, lengths, bits)


def scores(texts: list[bytes | None], model: Model) -> np.ndarray:
    """Probability of each text."""
    out = np.empty(len(texts))
    live = model.weights != 0
    for i, t in enumerate(texts):
        h = buckets(t, model.lengths, model.bits)
        out[i] = model.weights[np.unique(h[live[h]])].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -40, 40)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted.

    Null and empty texts get the score of a text without n-grams. Rows are scored alone, so repeats get equal
    scores; an empty table gives an empty result; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(scores(texts, model))})
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
