"""The given tables seen as the library's inputs: manifest, score table, tallies, registry, metadata.

FIXTURES.md describes the mapping; ``catalog/sqltext.py`` holds the same views for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import manifest as M

SEED = 34
TARGET_SIDE = 512
STREAM_MARKER = "stream-"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document before category folding."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    src = F.substring("source", 4, 9).cast("int")
    n = F.col("n_chars")
    width, height, size = 64 + n % 1500, 64 + (n * 7) % 1100, n * 3
    geo = S.geometry(width, height, size, TARGET_SIDE)
    ext = F.when(n % 3 == 0, "png").otherwise("jpg")
    return d.select(
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("image_id"),
        F.concat_ws("-", "source", "lang").alias("dataset"),
        F.when(F.col("lang") == "en", 0).otherwise(1).alias("label"),
        F.when(F.col("lang") == "en", "real").when(F.col("lang") == "de", "semisynthetic")
        .otherwise("synthetic").alias("kind"),
        F.when(F.col("lang") == "es", "niche").when(src % 5 == 0, "diverse")
        .otherwise(F.concat(F.lit("c"), (src % 5).cast("string"))).alias("content_category"),
        F.concat(F.lit("repo/"), F.col("source")).alias("source_path"),
        F.concat_ws("-", "source", "lang").alias("group"),
        F.concat(F.col("source"), F.lit("#"), (F.floor(F.col("doc_id") / 20) % 10).cast("string")).alias("source_file"),
        F.col("doc_id").alias("file_index"),
        ext.alias("ext"),
        F.when(ext == "png", "PNG").otherwise("JPEG").alias("file_format"),
        F.when(n % 7 == 0, "L").otherwise("RGB").alias("pil_mode"),
        F.when(F.col("lang") == "en", "real")
        .otherwise(F.concat(F.lit("gen-"), (src % 4).cast("string"))).alias("generator_family"),
        width.alias("width"), height.alias("height"), size.alias("file_bytes"),
        *[c.alias(k) for k, c in geo.items()])


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_categories(raw_manifest(spark, sf), "content_category", "label", "category")


def split_manifest(spark: SparkSession, sf: str, folded: bool = True) -> DataFrame:
    """Manifest with split_unit = its source and a split drawn from hashes of source and file."""
    m = (manifest if folded else raw_manifest)(spark, sf).withColumn("split_unit", F.col("source_path"))
    m = m.withColumn("_us", S.stable_fraction(F.col("source_path"), SEED)).withColumn(
        "_uf", S.stable_fraction(F.col("source_file"), SEED))
    u, r = F.col("_us"), F.col("_uf")
    split = (F.when(u < 0.15, "val_xgen").when(u < 0.3, "val_stress").when(u < 0.45, "test")
             .when(r < 0.2, "val_id").otherwise("train"))
    return m.withColumn("split", split).drop("_us", "_uf")


def branch_margins(first: int) -> list:
    e = F.col("embedding")
    bump = (F.col("label") - 4.5) / 5
    return [F.lit(4.0) * F.element_at(e, first + i).cast("double") + bump for i in range(3)]


def scored(spark: SparkSession, sf: str, view: str = "deploy") -> DataFrame:
    """Branch margins of the classifier under test; the robust view reads other components."""
    first = 1 if view == "deploy" else 4
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.concat(F.lit("emb-"), F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 3).cast("string")).alias("dataset"),
        F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"),
        F.when(F.col("label") < 5, 0).when(F.col("label") < 8, 1).otherwise(2).alias("y3"),
        F.array(*branch_margins(first)).alias("d"),
        (F.lit(4.0) * F.element_at("embedding", 7).cast("double") + (F.col("label") - 7.5) / 2).alias("d2"))


def scored_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The split manifest with three branch margins per row derived from the row's own numbers."""
    m = split_manifest(spark, sf)
    cols = []
    for i in range(3):
        noise = S.stable_fraction(F.col("image_id"), f"branch{i}") - 0.5
        lean = F.when(F.col("file_format") == "PNG", 0.3).otherwise(-0.1)
        cols.append((F.col("label") - 0.5) * 2.0 + noise * 4.0 + lean)
    return m.withColumn("d", F.array(*cols))


def tallies(spark: SparkSession, sf: str, where=None, model=None) -> DataFrame:
    """(truth, dataset, pred_label, n) counts of one classifier run, or of several told apart by ``model``."""
    e = table(spark, sf, "events")
    if where is not None:
        e = e.filter(where)
    u = F.col("user_id")
    truth = F.when(u % 3 == 0, "real").when(u % 3 == 1, "synthetic").otherwise("semisynthetic")
    mark = F.when(u % 7 == 0, "image-holdout-").when(u % 7 == 1, STREAM_MARKER).otherwise("")
    pred = (F.when(F.col("event_type").isin("view", "click"), "real")
            .when(F.col("event_type") == "purchase", "semisynthetic").otherwise("synthetic"))
    keys = {"truth": truth, "dataset": F.concat(F.lit("set-"), mark, (u % 21).cast("string")), "pred_label": pred}
    if model is not None:
        keys = {"model": model, **keys}
    return e.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("n"))
