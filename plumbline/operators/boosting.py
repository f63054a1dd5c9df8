"""Boosted trees on binned features: all folds, targets and sets of features in one pass over the rows.

Each feature is cut once into ``BINS`` bins with equally many rows. A level of a tree then takes one aggregation for all models
together: every row adds its gradient, its curvature and itself to the cells (model, node, feature, bin) of the models that
may learn from it, the others being those that will score it. Tasks add their rows up before they are shuffled, so a level
moves at most ``cells`` rows for each task, and the driver sees one row for each cell: a number that the models, the depth, the features and the
bins bound, whatever the rows. Sums are of whole numbers (units of 2**-32), so they come out alike in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.session import cut_lineage, parts_for, ship_package

#: Bins of a feature; bin 0 holds missing values.
BINS = 256
#: Gradients and curvatures are counted in such units; 2**31 rows of them stay below 2**63.
UNIT = 2.0 ** 32
#: Rounds after which the scores so far are written down instead of being worked out again.
WRITTEN = 25
#: Rows that a task adds up: enough to outweigh the cells it then hands on, few enough to keep all cores busy.
ROWS_PER_PART = 50_000


@dataclass(frozen=True)
class Group:
    """One model for each fold in 0..folds-1, fitted on the rows of all other folds that have a target.

    Rows with a null fold or target are left alone. ``features`` names the columns that the models see.
    """

    target: Column
    fold: Column
    features: tuple[str, ...]
    folds: int = 5


@dataclass(frozen=True)
class Shape:
    """Rounds and levels of the trees, their step, the least rows on a side of a cut, and the ridge on leaves."""

    rounds: int = 200
    depth: int = 4
    step: float = 0.1
    least: int = 20
    ridge: float = 1.0


def bin_edges(rows: DataFrame, features: Mapping[str, Column], bins: int = BINS) -> dict[str, np.ndarray]:
    """Upper ends of each feature's bins, ascending: a value's bin is the share of rows below its first copy, in ``bins - 1`` steps.

    Values are counted first and summed up in ordered buckets; the driver sees at most ``bins`` numbers for each feature.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), c.cast("double").alias("value")) for k, c in features.items()])).alias("s")
    counted = rows.select(each).select("s.*").filter("value IS NOT NULL AND NOT isnan(value)").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = R.running_total(counted, ["feature"], "value", ["n"])
    step = F.floor(F.col("n_before") * (bins - 1) / F.col("n_all"))
    ends = placed.groupBy("feature", step.alias("bin")).agg(F.max("value").alias("end")).collect()
    out = {k: [] for k in features}
    for r in ends:
        out[r["feature"]].append(r["end"])
    return {k: np.array(sorted(v), float) for k, v in out.items()}


def _binned(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [np.asarray(c.fill_null(math.nan), float) for c in batch.column("values").flatten()]
        cut = [np.where(np.isnan(v), 0, np.minimum(np.searchsorted(e, v), max(len(e) - 1, 0)) + 1) for v, e in zip(values, edges, strict=True)]
        table = np.stack(cut, 1).astype(np.uint8) if cut else np.zeros((len(batch), 0), np.uint8)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kept", "y", "fold")), pa.array([r.tobytes() for r in table], pa.binary())],
                                         names=["kept", "y", "fold", "bins"])


def walk(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Node that each row comes to after ``depth`` levels, counted from the left; ``columns`` has the bins by (feature, row).

    A level compares whole columns of bytes, one for each of its nodes."""
    node = np.zeros(columns.shape[1], np.uint8 if depth <= 8 else np.int64)
    for level in range(depth):
        right = np.zeros(columns.shape[1], bool)
        for k in range(2 ** level):
            at = 2 ** level - 1 + k
            if cut[at] < BINS - 1:  # else all rows stay on the left
                right |= (node == k) & (columns[feature[at]] > int(cut[at]))
        node = node * 2 + right
    return node


class Ensemble:
    """Trees of all models: ``feature`` and ``cut`` by (round, model, node), ``leaf`` by (round, model, leaf)."""

    def __init__(self, groups: Sequence[Group], places: Sequence[np.ndarray], shape: Shape, base: np.ndarray) -> None:
        self.places, self.depth, self.base = places, shape.depth, base
        self.group = np.concatenate([np.full(g.folds, k) for k, g in enumerate(groups)])
        self.fold = np.concatenate([np.arange(g.folds) for g in groups])
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def scores(self, bins: np.ndarray, so_far: np.ndarray | None, since: int) -> np.ndarray:
        """Log odds by (row, model): those written down, and the rounds after them."""
        out = np.tile(self.base[:, None], (1, len(bins))) if so_far is None else so_far.T.copy()
        columns = np.ascontiguousarray(bins.T)
        for m, g in enumerate(self.group):
            own = columns[self.places[g]]
            for feature, cut, leaf in zip(self.feature[since:], self.cut[since:], self.leaf[since:], strict=True):
                out[m] += leaf[m][walk(own, feature[m], cut[m], self.depth)]
        return out.T


def _unpacked(batch: pa.RecordBatch, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(batch)
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1)
    y, fold = (np.asarray(batch.column(c).flatten().fill_null(-1)).reshape(n, groups) for c in ("y", "fold"))
    return bins, y, fold


def _cells(batches: Iterator[pa.RecordBatch], trees: Ensemble, since: int, feature: np.ndarray, cut: np.ndarray, level: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(cell, g, h, n) of a task's rows at one level of the tree that is being grown."""
    width = max(map(len, trees.places))
    size = 2 ** level * width * BINS
    total = np.zeros((3, len(trees.group), size), np.int64)
    for batch in batches:
        bins, y, fold = _unpacked(batch, groups)
        kept = np.asarray(batch.column("scores").flatten()).reshape(len(batch), -1) if "scores" in batch.schema.names else None
        p = 1.0 / (1.0 + np.exp(-trees.scores(bins, kept, since)))
        for m, g in enumerate(trees.group):
            learn = np.flatnonzero((y[:, g] >= 0) & (fold[:, g] >= 0) & (fold[:, g] != trees.fold[m]))
            own = bins[learn][:, trees.places[g]]
            node = walk(np.ascontiguousarray(own.T), feature[m], cut[m], level).astype(np.int64)
            cell = ((node[:, None] * width + np.arange(own.shape[1])) * BINS + own).ravel()
            for k, v in enumerate((p[learn, m] - y[learn, g], p[learn, m] * (1 - p[learn, m]))):
                # Exact in 53 bits: a batch has fewer than 2**20 rows.
                total[k, m] += np.bincount(cell, np.repeat(np.rint(v * UNIT), own.shape[1]), size).astype(np.int64)
            total[2, m] += np.bincount(cell, minlength=size)
    m, at = np.nonzero(total[2])
    yield pa.RecordBatch.from_pydict({"cell": pa.array(m * size + at), "g": pa.array(total[0][m, at]), "h": pa.array(total[1][m, at]), "n": pa.array(total[2][m, at])})


def best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """For cells by (node, feature, bin): (feature, bin, left value, right value) of each node's best cut, rows with a bin above it
    going right. A node without a cut keeps all rows on the left. Of equal gains the first feature and the lowest bin win."""
    value = lambda a, b: -a / (b + shape.ridge)
    worth = lambda a, b: a * a / (b + shape.ridge)
    left = [np.cumsum(x, -1)[..., :-1] for x in (g, h, n)]
    whole = [x.sum(-1, keepdims=True) for x in (g, h, n)]
    right = [w - x for w, x in zip(whole, left, strict=True)]
    gain = worth(*left[:2]) + worth(*right[:2]) - worth(*whole[:2])
    gain = np.where((left[2] >= shape.least) & (right[2] >= shape.least), gain, 0.0)
    flat = gain.reshape(len(g), -1)
    at = flat.argmax(1)
    node = np.arange(len(g))
    f, b = at // gain.shape[-1], at % gain.shape[-1]
    cut = flat[node, at] > 1e-9
    f, b = np.where(cut, f, 0), np.where(cut, b, BINS - 1)
    all_g, all_h = whole[0][:, 0, 0], whole[1][:, 0, 0]
    lg, lh = (np.where(cut, x[node, f, np.minimum(b, gain.shape[-1] - 1)], w) for x, w in ((left[0], all_g), (left[1], all_h)))
    return f, b, value(lg, lh), value(all_g - lg, all_h - lh)


def _prepared(rows: DataFrame, features: Mapping[str, Column], groups: Mapping[str, Group], keep: Sequence[str]) -> tuple[DataFrame, str, str]:
    """(kept, y, fold, bins) of every row, written down, with the types of ``kept`` and of all.

    ``rows`` are worked out once; their features are written down, counted and dealt evenly, whatever partitions they came in.
    """
    ship_package(rows.sparkSession)
    many = list(groups.values())
    given = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.array(*[g.target.cast("int") for g in many]).alias("y"),
                        F.array(*[F.when((g.fold >= 0), g.fold).cast("int") for g in many]).alias("fold"),
                        F.struct(*[c.cast("double").alias(f"f{k}") for k, c in enumerate(features.values())]).alias("values"))
    frame = cut_lineage(given)
    edges = list(bin_edges(frame, {name: F.col(f"values.f{k}") for k, name in enumerate(features)}).values())
    kept = frame.select("kept").schema["kept"].dataType.simpleString()
    schema = f"kept {kept}, y array<int>, fold array<int>, bins binary"
    dealt = frame.repartition(parts_for(frame.count(), ROWS_PER_PART))
    return cut_lineage(dealt.mapInArrow(lambda b: _binned(b, edges), schema)), kept, schema


def _places(features: Mapping[str, Column], groups: Mapping[str, Group]) -> list[np.ndarray]:
    order = list(features)
    return [np.array([order.index(f) for f in g.features]) for g in groups.values()]


def first_histograms(rows: DataFrame, features: Mapping[str, Column], groups: Mapping[str, Group], keep: Sequence[str]) -> DataFrame:
    """(model, fold, feature, bin, n, positives): what the models see before their first cut, one row for each cell that has rows."""
    shape = Shape(depth=1)
    frame, _, _ = _prepared(rows, features, groups, keep)
    many, places, count = list(groups.values()), _places(features, groups), len(groups)
    trees = Ensemble(many, places, shape, np.zeros(sum(g.folds for g in many)))
    feature, cut, width = np.zeros((len(trees.group), 1), np.int64), np.full((len(trees.group), 1), BINS - 1), max(map(len, places))
    cells = frame.mapInArrow(lambda b: _cells(b, trees, 0, feature, cut, 0, count), "cell long, g long, h long, n long").groupBy("cell").agg(
        F.sum("g").alias("g"), F.sum("n").alias("n"))
    named = [(f"{k}", int(f), name) for m, (k, f) in enumerate((list(groups)[g], f) for g, f in zip(trees.group, trees.fold, strict=True))
             for name in [*many[trees.group[m]].features, *[""] * (width - len(many[trees.group[m]].features))]]
    names = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(f).alias("fold"), F.lit(x).alias("feature")) for k, f, x in named])
    # At even odds a row's gradient is a half, less one if it is positive.
    return cells.select(F.get(names, F.floor(F.col("cell") / BINS).cast("int")).alias("s"), (F.col("cell") % BINS).alias("bin"), "n",
                        F.round(F.col("n") / 2 - F.col("g") / UNIT).cast("long").alias("positives")).select("s.*", "bin", "n", "positives")


def out_of_fold(rows: DataFrame, features: Mapping[str, Column], groups: Mapping[str, Group], keep: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """``keep`` of every row and, for each group, ``oof_<name>``: the probability that the model of the row's own fold gives it.

    Null where the fold is null or outside 0..folds-1, or the training side has one class only. Missing values have a bin of their
    own. Ties between cuts go to the feature named first and the lowest bin, so the same rows give the same trees on any layout.
    """
    names, many, count = list(groups), list(groups.values()), len(groups)
    frame, kept, schema = _prepared(rows, features, groups, keep)
    sides = frame.select(F.posexplode(F.arrays_zip("y", "fold")).alias("k", "s")).filter("s.y IS NOT NULL AND s.fold IS NOT NULL").groupBy(
        "k", "s.fold", "s.y").agg(F.count(F.lit(1)).alias("n")).collect()
    places = _places(features, groups)
    one, zero = ([sum(r["n"] for r in sides if r["k"] == k and r["fold"] != f and r["y"] == v) for k, g in enumerate(many) for f in range(g.folds)] for v in (1, 0))
    fits = np.array([a > 0 and b > 0 for a, b in zip(one, zero, strict=True)])
    base = np.array([math.log(a / b) if a and b else 0.0 for a, b in zip(one, zero, strict=True)])
    trees = Ensemble(many, places, shape, base)
    models, width, nodes = len(base), max(map(len, places)), 2 ** shape.depth - 1
    state, since = frame, 0
    for turn in range(shape.rounds if fits.any() else 0):
        feature, cut = np.zeros((models, nodes), np.int64), np.full((models, nodes), BINS - 1)
        leaf = np.zeros((models, nodes + 1))
        for level in range(shape.depth):
            size = 2 ** level * width * BINS
            cells = state.mapInArrow(lambda b: _cells(b, trees, since, feature, cut, level, count), "cell long, g long, h long, n long")
            got = cells.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
            table = np.zeros((3, models * size))
            table[:, np.asarray(got["cell"])] = [np.asarray(got[c]) for c in "ghn"]
            table[:2] /= UNIT
            table = table.reshape(3, models, 2 ** level, width, BINS)
            for m in range(models):
                f, b, low, high = best_cuts(*table[:, m, :, : len(places[trees.group[m]])], shape)
                own = slice(2 ** level - 1, 2 ** (level + 1) - 1)
                feature[m, own], cut[m, own] = f, b
                if level == shape.depth - 1:
                    leaf[m] = shape.step * np.stack([low, high], 1).ravel()
        trees.feature.append(feature)
        trees.cut.append(cut)
        trees.leaf.append(np.where(fits[:, None], leaf, 0.0))
        if (turn + 1) % WRITTEN == 0 and turn + 1 < shape.rounds:
            done = len(trees.feature)
            state = cut_lineage(state.mapInArrow(lambda b: _written(b, trees, since), f"{schema}, scores array<double>"))
            since = done
    out = ", ".join(f"`oof_{k}` double" for k in names)
    scored = state.mapInArrow(lambda b: _scored(b, trees, since, names, fits), f"kept {kept}, {out}")
    return cut_lineage(scored.select("kept.*", *[f"`oof_{k}`" for k in names]))


def _known(batch: pa.RecordBatch) -> np.ndarray | None:
    return np.asarray(batch.column("scores").flatten()).reshape(len(batch), -1) if "scores" in batch.schema.names else None


def _written(batches: Iterator[pa.RecordBatch], trees: Ensemble, since: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins, _, _ = _unpacked(batch, len(trees.places))
        scores = trees.scores(bins, _known(batch), since)
        names = ["kept", "y", "fold", "bins"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(list(scores), pa.list_(pa.float64()))], names=[*names, "scores"])


def _scored(batches: Iterator[pa.RecordBatch], trees: Ensemble, since: int, names: list[str], fits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bins, _, fold = _unpacked(batch, len(names))
        p = 1.0 / (1.0 + np.exp(-trees.scores(bins, _known(batch), since)))
        cols = {"kept": batch.column("kept")}
        for k, name in enumerate(names):
            own = np.full(len(batch), np.nan)
            for m in np.flatnonzero((trees.group == k) & fits):
                mine = fold[:, k] == trees.fold[m]
                own[mine] = p[mine, m]
            cols[f"oof_{name}"] = pa.array(own, from_pandas=True)
        yield pa.RecordBatch.from_pydict(cols)
