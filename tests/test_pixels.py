"""Statistics of grids against their definitions, wave by wave."""

import math
import random

import numpy as np

from plumbline.operators import pixels as P


def direct(grid, tile):
    """One grid (3, side, side) by plain sums."""
    x, side = grid / 255.0, grid.shape[1]
    light = sum(w * x[c] for c, w in enumerate(P.BRIGHTNESS))
    power = {}
    for u in range(side):
        for v in range(side // 2 + 1):
            turn = [2 * math.pi * (u * y + v * z) / side for y in range(side) for z in range(side)]
            re, im = (sum(f(t) * a for t, a in zip(turn, light.ravel(), strict=True)) for f in (math.cos, math.sin))
            power[u, v] = (math.hypot(min(u, side - u), v) / side, re * re + im * im)
    band = [[p for f, p in power.values() if lo <= f < hi] for lo, hi in zip(P.BAND_ENDS, P.BAND_ENDS[1:], strict=False)]
    high, low = sum(p for f, p in power.values() if f > 0.35), sum(p for f, p in power.values() if 0 < f <= 0.0875)
    steps = [[(k, abs(light[y, k + 1] - light[y, k])) for y in range(side) for k in range(side - 1)], [(k, abs(light[k + 1, y] - light[k, y])) for y in range(side) for k in range(side - 1)]]
    mean = lambda v: sum(v) / len(v) if v else math.nan
    block = [mean([d for k, d in s if (k + 1) % tile == 0]) / max(mean([d for k, d in s if (k + 1) % tile]), 1e-9) for s in steps]
    sat = x.max(0) - x.min(0)
    level = [min(int(t * 255 * 32 // 255), 31) for t in light.ravel()]
    share = [level.count(k) / len(level) for k in set(level)]
    return [*x.mean((1, 2)), *x.std((1, 2), ddof=1), *[math.log1p(mean(b) if b else 0) for b in band], math.log1p(high / max(low, 1e-9)), mean(block), sat.mean(),
            sat.std(ddof=1), (mean([d for _, d in steps[0]]) + mean([d for _, d in steps[1]])) / 2, -sum(p * math.log2(p) for p in share)]


def test_statistics():
    rng = np.random.default_rng(3)
    for side, tile in ((5, 2), (9, 8), (16, 8), (6, 3)):
        grids = rng.integers(0, 256, (3, 3, side, side)).astype(float)
        got = P.statistics(grids, tile)
        for g, row in zip(grids, got, strict=True):
            want = direct(g, tile)
            assert all((math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(row, want, strict=True))


def test_odd_rows(spark):
    rng = random.Random(1)
    square = lambda n: [rng.randrange(256) for _ in range(n * n)]
    rows = [(1, square(8), square(8), square(8)), (2, None, square(8), square(8)), (3, square(8), square(7), square(8)), (4, [1, 2, 3], [1, 2, 3], [1, 2, 3]), (5, [], [], []),
            (6, [255] * 256, [0] * 256, [0] * 256), (6, [255] * 256, [0] * 256, [0] * 256), (None, [7], [7], [7]), (8, [None] * 81, square(9), square(9))]
    df = spark.createDataFrame(rows, "k long, r array<int>, g array<int>, b array<int>")
    got = {}
    for r in P.pixel_stats(df, "k", "r", "g", "b").collect():
        got.setdefault(r.k, []).append(r)
    assert all(v is None for k in (2, 3, 4, 5) for v in got[k][0][1:])
    assert got[1][0].mean_r is not None and got[1][0].blockiness is None  # a side of eight has no tile edge inside
    assert len(got[6]) == 2 and got[6][0] == got[6][1] and got[6][0].hist_entropy == 0 and got[6][0].sat_mean == 1 and got[6][0].std_r == 0
    assert got[None][0].mean_r is not None and got[None][0].std_r is None and got[8][0].mean_r == 0
    assert P.pixel_stats(df.limit(0), "k", "r", "g", "b").count() == 0
