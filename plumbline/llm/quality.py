"""Quality score: kernel ridge regression over document statistics with random Fourier features, then isotonic calibration.

A text becomes some twenty statistics (lengths, character classes, repetition, shape of words and lines). Standardised,
they pass through ``features`` random cosines, whose inner products approximate a Gaussian kernel. Each partition
sums its share of the normal equations over the labelled rows; their sum, of a size set by ``features``, is solved
once. Scores of a fifth of the training rows, counted in slices, give the increasing step function to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import filter_bits, key_filter, maybe_in, sliced
from plumbline.llm.toxicity import held_out, training_labels
from plumbline.session import cut_lineage

FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1.0, 7
#: Slices of a unit of score in which calibration rows are counted.
SLICES = 1_000
#: Rows of partial sums that the driver adds up.
SUMS = 16
THRESHOLD = 0.7
_CLASSES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (_b > 127, _b < 128 and _c.isupper(), _b < 128 and _c.islower(), _c in "0123456789", _b in (9, 10, 11, 12, 13, 32),
                    32 < _b < 127 and not _c.isalnum())
_MARKS = frozenset(b".,;:?")
STATISTICS = ("log_bytes", "log_words", "log_lines", "beyond_ascii", "upper", "lower", "digit", "blank", "mark", "odd_mark",
              "word_mean", "word_spread", "word_longest", "distinct_words", "distinct_lower", "most_frequent", "same_as_before",
              "upper_words", "mark_ended", "mark_words", "distinct_lines", "words_in_line", "ended_lines")


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text; all 0 but for the logarithms' own values in an empty one."""
    text = text or b""
    n, w, lines = len(text), text.split(), [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = counts @ _CLASSES / max(n, 1)
    if not w:
        return [np.log1p(n), 0.0, 0.0, *kinds, *[0.0] * (len(STATISTICS) - 9)]
    k, low = len(w), text.lower().split()
    sizes = np.fromiter(map(len, w), np.int64, k)
    seen: dict[bytes, int] = {}
    for x in low:
        seen[x] = seen.get(x, 0) + 1
    odd = kinds[5] - sum(int(counts[m]) for m in _MARKS) / n
    return [np.log1p(n), np.log1p(k), np.log1p(len(lines)), *kinds, odd, sizes.mean(), sizes.std(), np.log1p(sizes.max()),
            len(set(w)) / k, len(seen) / k, max(seen.values()) / k, sum(map(bytes.__eq__, low[1:], low)) / k,
            sum(map(bytes.isupper, w)) / k, sum(not x[-1:].isalnum() and x[-1] < 128 for x in w) / k,
            sum(not x[:1].isalnum() and x[0] < 128 for x in w) / k, len(set(lines)) / max(len(lines), 1), np.log1p(k / max(len(lines), 1)),
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(len(lines), 1)]


@dataclass
class Model:
    """Standardisation, random directions, weights and the calibration's points (score, probability); ``fitted`` is false
    where there was no labelled row."""
    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    probability: np.ndarray
    fitted: bool = True

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.ones(len(z)), z, np.cos(z @ self.turn + self.shift) * (2 / len(self.shift)) ** 0.5])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.probability)


def isotonic(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and means for points at increasing ``at`` with mean y and weight n."""
    blocks: list[list[float]] = []
    for p in zip(at, y, n, strict=True):
        blocks.append(list(p))
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            (a, u, k), (b, v, m) = blocks[-2:]
            blocks[-2:] = [[(a * k + b * m) / (k + m), (u * k + v * m) / (k + m), k + m]]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every text, in a table of its own since a row of them is short."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text"):
            rows = [statistics(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "x": pa.array(rows, pa.list_(pa.float64()))})
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return cut_lineage(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>"))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", features: int = FEATURES, width: float = WIDTH,
        ridge: float = RIDGE, seed: int = SEED) -> Model:
    """A model from all labelled rows of ``stats(id, x)`` that are not held out; one fifth of them, by hash, calibrates.

    Without labels it answers 0.5; with few, the same rows also calibrate.
    """
    d = len(STATISTICS)
    rows = cut_lineage(stats.join(training_labels(labels, key, label), "id").select("x", "y", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("late")))
    parts = {r["late"]: r for r in rows.groupBy("late").agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).collect()}
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features)
    model = Model(np.zeros(d), np.ones(d), turn, shift, np.zeros(1 + d + features), np.array([0.0]), np.array([0.5]),
                  bool(parts) and min(r["low"] for r in parts.values()) < max(r["high"] for r in parts.values()))
    if not parts:
        return model
    base = parts.get(False) or parts[True]
    early, late = rows.filter(~F.col("late")) if False in parts else rows, rows.filter("late") if True in parts else rows
    model.mean = np.array([base[f"m{i}"] for i in range(d)])
    model.spread = np.array([base[f"s{i}"] if base[f"s{i}"] > 1e-9 else 1.0 for i in range(d)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 + d + features, 2 + d + features))
        for batch in batches:
            if len(batch):
                z, y = model.features(_matrix(batch.column("x"))), np.asarray(batch.column("y"))
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(total.size)), "v": pa.array(total.ravel())})

    cells = early.select("x", "y").mapInArrow(sums, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((1 + d + features) * (2 + d + features))
    total[np.asarray(cells["cell"])] = np.asarray(cells["v"])
    total = total.reshape(1 + d + features, -1)
    model.weights = np.linalg.solve(total[:, :-1] + ridge * np.eye(len(total)), total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.floor(np.clip(model.raw(_matrix(batch.column("x"))), -2, 3) * SLICES).astype(np.int64) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(s), "y": batch.column("y")})

    found = late.select("x", "y").mapInArrow(raw, "slice long, y double").groupBy("slice").agg(
        F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
    at, p = isotonic(np.array([(r["slice"] + 0.5) / SLICES for r in found]), np.array([r["y"] for r in found]), np.array([float(r["n"]) for r in found]))
    model.at, model.probability = at, np.clip(p, 0.0, 1.0)
    return model


def score(stats: DataFrame, model: Model, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``stats(id, x)``: key, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model(_matrix(batch.column("x"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(s)})
    found = stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")
    return found.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Fit on the labels and score every row of ``docs``: key, held_out, score, predicted.

    Null and empty texts get the score of their statistics; a null key is never labelled and not held out; rows are
    scored alone, so repeats get equal scores; where a key has several labels the larger counts. An empty table gives
    an empty result; other columns are not read.
    """
    stats = document_statistics(docs, key, text)
    return score(stats, fit(stats, labels, key, label), key)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score lies below the threshold; nulls as in ``score_documents``. All columns are kept.
    Without labelled rows of both classes to fit on there is nothing to judge by, and all rows are kept. Statistics to fit on
    are taken of rows only that may have a label, by a bounded Bloom filter over the labelled keys."""
    known = cut_lineage(training_labels(labels, key, label).select("id"))
    bits = filter_bits(known.count(), 12, 2**31, 2)
    some = maybe_in(docs.select(F.col(key), F.col(text)), F.col(key).cast("long"), key_filter(known.select(F.col("id").cast("long")), "id", bits), bits, 2, "_maybe")
    model = fit(document_statistics(some.filter("_maybe").drop("_maybe"), key, text), labels, key, label)
    if not model.fitted:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, text):
            good = model(np.array([statistics(t) for t in texts])) >= threshold
            yield batch.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
