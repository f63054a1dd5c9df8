"""Reading JSON metadata, benchmark records, tallies and name lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas


def iso_week(ts: Column) -> Column:
    """2025W40 style."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("W"),
                    F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def metadata_fields(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per top-level field of a JSON object; unreadable text gives no rows."""
    fields = F.from_json(F.col(column), "map<string,string>")
    return df.select(key, F.explode(fields).alias("field", "value"))


def sample_metadata(files: DataFrame, dataset: str, text: str) -> DataFrame:
    """Whole-file JSON in either shape, {file: {...}} or [{...}], as one row per file."""
    # The list form names its file by source_file, else filename, else the position.
    head = F.substring(F.ltrim(F.col(text)), 1, 1)
    as_map = F.from_json(F.when(head == "{", F.col(text)), schemas.SAMPLE_META)
    as_list = F.from_json(F.when(head == "[", F.col(text)), schemas.SAMPLE_META_LIST)
    left = files.select(dataset, F.explode(as_map).alias("file", "m")).select(
        dataset, "file", "m.source_file", "m.model_name", "m.iso_week")
    right = files.select(dataset, F.posexplode(as_list).alias("i", "m")).select(
        dataset, F.coalesce("m.source_file", "m.filename", F.col("i").cast("string")).alias("file"),
        "m.source_file", "m.model_name", "m.iso_week")
    return left.unionByName(right)


def read_records(records: DataFrame) -> DataFrame:
    """Rows with probabilities: p_fake = 1 - probs[0], y = label above zero, aug false when absent."""
    aug = F.coalesce(F.col("aug_pass"), F.lit(False)) if "aug_pass" in records.columns else F.lit(False)
    return (records.filter(F.col("probs").isNotNull())
            .withColumn("p_fake", F.lit(1.0) - F.element_at("probs", 1))
            .withColumn("y", F.when(F.col("label") > 0, 1).otherwise(0))
            .withColumn("aug", aug).drop("probs", "aug_pass", "label"))


def read_tallies(docs: DataFrame, column: str) -> DataFrame:
    """{truth: {dataset: {prediction: n}}} documents -> (truth, dataset, pred_label, n)."""
    t = docs.select(F.explode(F.from_json(F.col(column), schemas.TALLIES)).alias("truth", "sets"))
    t = t.select("truth", F.explode("sets").alias("dataset", "counts"))
    return t.select("truth", "dataset", F.explode("counts").alias("pred_label", "n"))


def name_list(spark: SparkSession, args: Sequence[str]) -> DataFrame:
    """Literal names, and @path for a file with names separated by white space."""
    literal = [(a,) for a in args if not a.startswith("@")]
    out = spark.createDataFrame(literal, "name string")
    for a in args:
        if a.startswith("@"):
            words = spark.read.text(a[1:]).select(F.explode(F.split("value", r"\s+")).alias("name"))
            out = out.unionByName(words.filter("name <> ''"))
    return out.distinct()
