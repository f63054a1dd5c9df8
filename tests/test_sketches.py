"""Sketches of cells united for slices, against the rows."""

import random

from pyspark.sql import functions as F

from plumbline.operators import sketches as K


def test_slices(spark):
    rng = random.Random(2)
    rows = [(f"s{k % 3}", rng.randrange(40), rng.randrange(9_000), rng.gauss(0, 5), k % 2) for k in range(60_000)] + [("s0", 1, None, None, 0), (None, 1, 5, 1.0, 1)]
    df = spark.createDataFrame(rows, "split string, week int, item int, v double, odd int").repartition(5)
    t = K.sketch_table(df, ["split", "week", "odd"], {"item": F.col("item")}, {"v": F.col("v")}, {"item": F.col("item")}).cache()
    assert t.count() == len({(r[0], r[1], r[4]) for r in rows})
    for r in K.distinct_estimates(t, ["split"], "item").collect():
        own = [x for x in rows if x[0] == r.split]
        exact = len({x[2] for x in own if x[2] is not None})
        assert r.rows == len(own) and abs(r.estimate - exact) <= max(1, exact * K.DISTINCT_BOUND)
    whole = sorted(x[3] for x in rows if x[3] is not None)
    for r in K.quantile_estimates(t, [], "v", [0.1, 0.5, 0.9]).collect():
        below = sum(x < r.value for x in whole) / len(whole)
        assert abs(below - r.prob) <= K.RANK_BOUND
    for r in K.shared_estimates(t, F.when(F.col("odd") == 0, "left").otherwise("right"), ["split"], "item").collect():
        a, b = ({x[2] for x in rows if x[0] == r.split and x[4] == k and x[2] is not None} for k in (0, 1))
        bound = max(1, len(a | b) * K.SET_BOUND)
        assert abs((r.both or 0) - len(a & b)) <= bound and abs(r.either - len(a | b)) <= bound
    t.unpersist()


def test_nulls_only(spark):
    df = spark.createDataFrame([("a", None, None)], "split string, item int, v double")
    t = K.sketch_table(df, ["split"], {"item": F.col("item")}, {"v": F.col("v")}, {"item": F.col("item")})
    assert K.distinct_estimates(t, ["split"], "item").first().estimate == 0
    assert K.quantile_estimates(t, ["split"], "v", [0.5]).count() == 0
    assert K.sketch_table(df.limit(0), ["split"], {"item": F.col("item")}).count() == 0
