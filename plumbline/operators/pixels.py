"""Low-level statistics of square three-channel grids of 0..255, as they reach a model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship_package

# Weights of the channels in the brightness, ends of the eight log-spaced bands of frequency in cycles per step, where
# low and high ones end and begin, levels of the histogram over 0..255, and the side of a coding tile.
BRIGHTNESS = (0.299, 0.587, 0.114)
BAND_ENDS = tuple(0.01 * 70.0 ** (k / 8) for k in range(9))
LOW_TO, HIGH_FROM, LEVELS, TILE = 0.0875, 0.35, 32, 8
PIXEL_STATS = ("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", *(f"fft_band_{k}" for k in range(8)), "hf_lf_ratio", "blockiness",
               "sat_mean", "sat_std", "edge_density", "hist_entropy")
#: Numbers that are held as grids at a time.
AT_ONCE = 200_000


def frequencies(side: int) -> np.ndarray:
    """Cycles per step of each wave of the real two-dimensional transform, by (row wave, column wave)."""
    return np.hypot(np.minimum(np.arange(side), side - np.arange(side))[:, None], np.arange(side // 2 + 1)[None, :]) / side


def _tiles(steps: np.ndarray, tile: int) -> np.ndarray:
    """Mean step over tile edges against the mean step elsewhere, along the last axis; NaN without any edge."""
    edge = (np.arange(steps.shape[2]) + 1) % tile == 0
    if not edge.any() or edge.all():
        return np.full(len(steps), np.nan)
    return steps[:, :, edge].mean((1, 2)) / np.maximum(steps[:, :, ~edge].mean((1, 2)), 1e-9)


def statistics(grids: np.ndarray, tile: int = TILE) -> np.ndarray:
    """PIXEL_STATS by column for grids (n, 3, side, side) of 0..255. The transform goes over rows, then over columns."""
    n, _, side, _ = grids.shape
    x = grids / 255.0
    scale = BRIGHTNESS[0] * grids[:, 0] + BRIGHTNESS[1] * grids[:, 1] + BRIGHTNESS[2] * grids[:, 2]
    light = scale / 255.0
    spread = (lambda v: v.std((1, 2), ddof=1)) if side > 1 else (lambda v: np.full(n, np.nan))
    power = np.abs(np.fft.fft(np.fft.rfft(light, axis=2), axis=1)) ** 2
    r = frequencies(side)
    bands = [np.log1p(power[:, m].sum(1) / max(m.sum(), 1)) for lo, hi in zip(BAND_ENDS, BAND_ENDS[1:], strict=False) for m in [(r >= lo) & (r < hi)]]
    high, low = power[:, r > HIGH_FROM].sum(1), power[:, (r > 0) & (r <= LOW_TO)].sum(1)
    across, down = np.abs(np.diff(light, axis=2)), np.abs(np.diff(light, axis=1)).transpose(0, 2, 1)
    full = x.max(1) - x.min(1)
    mean = lambda v: v.mean((1, 2)) if side > 1 else np.full(n, np.nan)
    level = np.minimum(np.floor(scale * LEVELS / 255.0), LEVELS - 1).astype(np.int64).reshape(n, -1)
    share = np.stack([(level == k).mean(1) for k in range(LEVELS)], 1)
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
    return np.stack([*(x[:, c].mean((1, 2)) for c in range(3)), *(spread(x[:, c]) for c in range(3)), *bands, np.log1p(high / np.maximum(low, 1e-9)),
                     (_tiles(across, tile) + _tiles(down, tile)) / 2, full.mean((1, 2)), spread(full), (mean(across) + mean(down)) / 2, entropy], 1)


def _rows(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.full((len(batch), len(PIXEL_STATS)), np.nan)
        parts = [batch.column(c) for c in "rgb"]
        size = np.stack([np.asarray(p.value_lengths().fill_null(-1), np.int64) for p in parts], 1)
        start = np.cumsum(np.maximum(size, 0), 0) - np.maximum(size, 0)
        flat = [np.asarray(p.flatten().fill_null(0.0), float) for p in parts]
        for n in np.unique(size[:, 0]):
            side = math.isqrt(max(int(n), 0))
            own = np.flatnonzero((size == n).all(1)) if side and side * side == n else []
            step = max(1, AT_ONCE // max(3 * int(n), 1))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                grids = np.stack([v[start[some, c, None] + np.arange(n)] for c, v in enumerate(flat)], 1)
                out[some] = statistics(np.nan_to_num(grids.reshape(len(some), 3, side, side)), tile)
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), **{c: pa.array(out[:, k], from_pandas=True) for k, c in enumerate(PIXEL_STATS)}})


def pixel_stats(rows: DataFrame, key: str, r: str, g: str, b: str, tile: int = TILE) -> DataFrame:
    """key and PIXEL_STATS of every row. The channels are arrays of side * side numbers from 0 to 255, row by row.

    Rows whose channels are null, empty, of unequal length or not square have null statistics; a null inside a channel counts as 0.
    Blockiness is null where a side has no tile edge. Rows are handled alone, nothing is shuffled.
    """
    ship_package(rows.sparkSession)
    given = rows.select(F.col(key).alias("key"), *[F.col(c).cast("array<double>").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])
    kind = given.schema["key"].dataType.simpleString()
    out = given.mapInArrow(lambda batches: _rows(batches, tile), f"key {kind}, " + ", ".join(f"{c} double" for c in PIXEL_STATS))
    return out.withColumnRenamed("key", key)
