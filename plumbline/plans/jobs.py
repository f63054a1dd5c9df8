"""Plans of generation jobs: edits of training rows, swaps between sources, prompts.

A plan is a table; nothing is generated. Rows are taken by equality joins on a number inside their
group, so a group of any size is never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.operators.ingest import pseudo_shard
from plumbline.operators.sampling import numbered_rows

BLOCK = 64


def _file(i: Column) -> Column:
    return F.concat(F.lit("img_"), S.padded(i, 6), F.lit(".jpg"))


def edit_plan(rows: DataFrame, per_source: int, editors: Sequence[str], seed: int, quality: tuple[int, int] = (88, 96)) -> DataFrame:
    """``per_source`` jobs for every dataset with train rows: rows in hash order, reused in turn when
    they run out; editors alternate; each job has its own seed and quality."""
    train = rows.filter("split = 'train'")
    size = train.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    jobs = size.select("dataset", "n", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1))).alias("job"))
    jobs = jobs.withColumn("row_no", (F.col("job") % F.col("n")).cast("bigint"))
    key = F.concat_ws("|", "dataset", F.col("job").cast("string"))
    lo, hi = quality
    editor = F.element_at(F.array(*[F.lit(e) for e in editors]), (F.col("job") % len(editors) + 1).cast("int"))
    j = jobs.join(numbered_rows(train, ["dataset"], seed), ["dataset", "row_no"])
    return j.select("dataset", "job", _file(F.col("job")).alias("fname"), "image_id", editor.alias("editor"),
                    (S.stable_fraction(key, f"{seed}|face") < 0.5).alias("want_face"),
                    (S.stable_choice(key, f"{seed}|quality", hi - lo + 1) + lo).cast("int").alias("quality"),
                    S.stable_choice(key, f"{seed}|seed", 2**31).alias("job_seed"),
                    pseudo_shard(F.col("dataset"), F.col("job"), BLOCK, "blk").alias("source_file"))


def swap_plan(rows: DataFrame, jobs: int, seed: int, target: str | None = None, quality: tuple[int, int] = (88, 96)) -> DataFrame:
    """Donor and target row of every job, from two different datasets; ``target`` fixes the second."""
    size = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("dataset")) - 1
    names = size.withColumn("at", at.cast("bigint"))
    total = size.agg(F.count(F.lit(1))).scalar()
    j = rows.sparkSession.range(jobs).withColumnRenamed("id", "job").withColumn("_k", F.col("job").cast("string"))
    k = F.col("_k")
    if target is None:
        j = j.withColumn("dst_at", S.stable_choice(k, f"{seed}|dst", total))
    else:
        j = j.withColumn("dst_at", names.filter(F.col("dataset") == target).select("at").scalar())
    # A step of 1 .. total - 1 from the target never lands on it.
    j = j.withColumn("src_at", (F.col("dst_at") + 1 + S.stable_choice(k, f"{seed}|src", total - 1)) % total)
    numbered = numbered_rows(rows, ["dataset"], seed)
    for side in ("src", "dst"):
        d = names.select(F.col("dataset").alias(f"{side}_dataset"), F.col("n").alias(f"{side}_n"), F.col("at").alias(f"{side}_at"))
        j = j.join(d, f"{side}_at").withColumn(f"{side}_no", S.stable_choice(k, f"{seed}|{side}row", F.col(f"{side}_n")))
        r = numbered.select(F.col("dataset").alias(f"{side}_dataset"), F.col("row_no").alias(f"{side}_no"), F.col("image_id").alias(f"{side}_id"))
        j = j.join(r, [f"{side}_dataset", f"{side}_no"])
    lo, hi = quality
    return j.select("job", _file(F.col("job")).alias("fname"), "src_dataset", "src_id", "dst_dataset", "dst_id",
                    (S.stable_choice(k, f"{seed}|quality", hi - lo + 1) + lo).cast("int").alias("quality"),
                    pseudo_shard(F.col("dst_dataset"), F.col("job"), BLOCK, "blk").alias("source_file"))


def prompt_plan(subjects: DataFrame, adjectives: Sequence[str], styles: Sequence[str], prompts: int, seed: int) -> DataFrame:
    """Prompts that go round the categories evenly; template, adjective and style by hash.

    ``subjects(category, template)``; a template may hold {adj}.
    """
    cats = subjects.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("category")) - 1
    cats = cats.withColumn("at", at.cast("bigint"))
    total = cats.agg(F.count(F.lit(1))).scalar()
    copies = subjects.groupBy("category", "template").agg(F.count(F.lit(1)).alias("n"))
    placed = R.running_total(copies, ["category"], "template", ["n"])
    numbered = placed.select("category", "template", F.explode(F.sequence(F.col("n_before"), F.col("n_before") + F.col("n") - 1)).alias("template_no"))
    j = subjects.sparkSession.range(prompts).withColumnRenamed("id", "job").withColumn("at", F.col("job") % total)
    k = F.col("job").cast("string")
    j = j.join(cats, "at").withColumn("template_no", S.stable_choice(k, f"{seed}|template", F.col("n")))
    j = j.join(numbered, ["category", "template_no"])

    def one(values: Sequence[str], tag: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (S.stable_choice(F.col("job").cast("string"), f"{seed}|{tag}", len(values)) + 1).cast("int"))

    text = F.concat_ws(", ", F.replace(F.col("template"), F.lit("{adj}"), one(adjectives, "adj")), one(styles, "style"))
    return j.select("job", "category", text.alias("prompt"), F.floor(F.col("job") / BLOCK).alias("block"))
