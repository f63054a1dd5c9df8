"""A corpus pipeline: quality, exact and near copies, benchmark passages, mixing. Documents in, documents to train on out.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with their columns; the last adds
``mix_repeats``, how often a document is to be read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from plumbline.llm.queries import table
from plumbline.session import ensure_checkpoint_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier, fitted on the labels, rejects. Null and empty texts are scored by their
    statistics; repeated rows share a fate; without labelled rows of both classes all stay. An empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; null counts as the empty text, and of rows that
    repeat the id that stays one is left. An empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: a Jaccard similarity of 0.8 or more in shingles of five words. The smallest id
    stays with all its rows; rows without words or without an id stay. An empty table stays empty."""
    return near_dedup.drop_near_copies(docs, size=5, share=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more are words of benchmark windows. Null and empty texts have no words and stay;
    repeated rows share a fate; without a benchmark all stay. An empty table stays empty."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target mix of sources takes, with ``mix_repeats``. Texts without words are not taken; a null source is a
    source; rows that repeat an id are taken together. An empty table stays empty."""
    return mixing.mix(docs)


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("decontamination", without_benchmark), ("mixing", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the shared checkpoint folder and read again, so that a
    lost executor costs a part of one stage; the folder, pipeline-<id>, is the caller's to remove."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs


#: The classifier of the first stage cannot be stated in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None
Q, SQL = {"pipeline": run}, {}
