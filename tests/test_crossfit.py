"""Cross-fitted sigmoids: all folds in one aggregation a step."""

import math
import random

from plumbline.operators import calibration as K


def fitted(rows):
    """Plain Newton on rows (y, m)."""
    a, b = 1.0, 0.0
    for _ in range(60):
        ga = gb = haa = hab = hbb = 0.0
        for y, m in rows:
            p = 1 / (1 + math.exp(-(a * m + b)))
            ga, gb = ga + (p - y) * m, gb + p - y
            haa, hab, hbb = haa + p * (1 - p) * m * m, hab + p * (1 - p) * m, hbb + p * (1 - p)
        det = haa * hbb - hab * hab
        a, b = a - (ga * hbb - gb * hab) / det, b - (gb * haa - ga * hab) / det
    return a, b


def test_all_folds_in_few_jobs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1_500):
        y = rng.randrange(2)
        rows.append((y, round(rng.gauss(2 * y - 0.3, 2.0), 1), k % 12))
    rows += [(None, 1.0, 0), (1, None, 0), (0, 1.0, None)]
    df = spark.createDataFrame(rows, "y int, margin double, fold int").repartition(4)
    spark.sparkContext.setJobGroup("crossfit", "crossfit")
    got = {r.fold: (r.a, r.b) for r in K.crossfit_platt(df, "fold", 12).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("crossfit"))
    spark.sparkContext.setJobGroup("other", "other")
    # Adaptive plans run the two sides of an exchange as jobs of their own.
    assert jobs <= 2 * (K.PLATT_STEPS + 2)
    for f in range(12):
        a, b = fitted([(y, m) for y, m, g in rows if None not in (y, m, g) and g != f])
        assert abs(got[f][0] - a) < 1e-7 and abs(got[f][1] - b) < 1e-7


def test_odd_folds(spark):
    df = spark.createDataFrame([(1, 2.0, 0), (1, 1.0, 0), (0, -1.0, 1), (1, 0.5, 1), (0, 0.7, 1)], "y int, margin double, fold int")
    got = {r.fold: (r.a, r.b) for r in K.crossfit_platt(df, "fold", 3).collect()}
    assert got[1] == (1.0, 0.0) and all(map(math.isfinite, (*got[0], *got[2])))
    assert K.crossfit_platt(df.limit(0), "fold", 2).collect()[0].a == 1.0
    apart = spark.createDataFrame([(int(m > 0), float(m), k % 2) for k, m in enumerate(range(-20, 20))], "y int, margin double, fold int")
    assert all(r.a > 1 and math.isfinite(r.a) for r in K.crossfit_platt(apart, "fold", 2).collect())  # separable: steep but finite
