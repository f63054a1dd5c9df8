"""Steps whose work outgrew their input: done once, dealt evenly, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import boosting as T
from plumbline.operators import modes as MO
from plumbline.operators import pixels as P


def test_word_stats(spark, monkeypatch):
    monkeypatch.setattr(A, "TEXT_AT_ONCE", 64)
    rng = random.Random(5)
    texts = ["", " ", "one", " a", "a \t\n b ", "é𝄞 x\x0by\x0cz\r", "\u00a0a\u2003b", None, *("".join(rng.choice("ab é𝄞\t\n-") for _ in range(rng.randrange(60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    lengths = F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), F.length)
    want = {r.k: r for r in A.array_stats(df.select("k", lengths.alias("a")), "k", "a").collect()}
    got = A.word_stats(df, "k", "text").collect()
    assert len(got) == len(texts) and all(r == want[r.k] for r in got)
    assert A.word_stats(df.limit(0), "k", "text").count() == 0


def test_statistics_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)
    stats = spark.range(60).select(F.col("id").cast("string").alias("image_id"), F.lit("plain").alias("variant"), counted("id").alias("s"))
    rows = spark.range(60).select(F.col("id").cast("string").alias("image_id"), (F.col("id") % 2).alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    results, single = A.tensor_probes(stats, rows, {}, ["s"], "plain", shape=T.Shape(rounds=1, depth=1))
    assert results.count() == 1 and single.count() == 1 and seen.value == 60


def test_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_PART", 100)
    df = spark.range(950).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("y"), (F.col("id") % 3).cast("int").alias("fold")).coalesce(1)
    frame, _, _ = T._prepared(df, {"a": F.col("a")}, {"y": T.Group(F.col("y"), F.col("fold"), ("a",), 3)}, ["id"])
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 950 and max(sizes) < 200


def test_probes_asked_for(spark):
    rng = random.Random(8)
    made = [(f"i{k}", f"d{k % 9}", k % 9 % 2, ("train", "val_id", "test")[k % 3], float(rng.randrange(50) + 9 * (k % 2)), "png" if k % 5 else "jpg") for k in range(300)]
    df = spark.createDataFrame(made, "image_id string, dataset string, label int, split string, width double, ext string")
    shape = T.Shape(rounds=2, depth=2, step=0.4)
    some = MO.metadata_probes(df, ["width"], ["ext"], shape=shape, only=("blocked", "val"))
    assert some.columns == ["split", "label", "oof_blocked", "oof_val"]
    of = lambda t: {(r.test, r.split): (r.n, r.value) for r in MO.metadata_probe_rows(t).collect()}
    whole, part = of(MO.metadata_probes(df, ["width"], ["ext"], shape=shape)), of(some)
    assert part == {k: v for k, v in whole.items() if k[0] in ("M1_metadata_probe", "M4_val_inheritance")} and len(part) == 2


def test_walk():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 256, (500, 6)).astype(np.uint8)
    for depth in (0, 1, 3, 4, 9):
        feature, cut = rng.integers(0, 6, 2**depth), rng.choice([0, 7, 130, 254, 255], 2**depth)
        got = T.walk(np.ascontiguousarray(bins.T), feature, cut, depth)
        for row, end in zip(bins, got, strict=True):
            node = 0
            for _ in range(depth):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            assert end == node - (2**depth - 1)


def test_memory_of_grids():
    n, side = 10_000, 16
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * side * side)
    channels = [pa.ListArray.from_arrays(ends, pa.array(np.random.default_rng(k).integers(0, 256, n * side * side).astype(float))) for k in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *channels], names=["key", "r", "g", "b"])
    tracemalloc.start()
    out = list(P._rows(iter([batch]), P.TILE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out[0]) == n and out[0].column("mean_r").null_count == 0 and peak < batch.nbytes
