"""Writing manifests, tables, reports and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.session import cut_lineage


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Declared schema; filters on split prune folders, the rest reaches the parquet scan."""
    return spark.read.schema(schemas.MANIFEST).parquet(path)


def write_manifest(rows: DataFrame, path: str, rules: DataFrame | None = None, write: bool = True) -> DataFrame | None:
    """Write one folder per split unless a rule of severity error is broken. ``write=False`` only checks.

    Rows are taken from their source before anything is overwritten, so that ``path`` may be the table they were read
    from; a split is written in files of the session's advisory size, large splits in several.
    """
    if rules is not None:
        errors = rules.filter("severity = 'error'")
        first = errors.orderBy("code", "subject").limit(5).collect()
        if first:
            raise ValueError("not written: " + "; ".join(f"{r['code']} {r['subject']}" for r in first))
    if write:
        cut_lineage(rows).hint("rebalance", "split").write.mode("overwrite").partitionBy("split").parquet(path)
    return rules


def write_contents(ingested: DataFrame, content: str, path: str) -> None:
    """The kept items' names and bytes as they came, one row each; ``ingested`` from ``ingest(..., keep_content=True)``."""
    ingested.select("fname", "content_hash", F.col(content).alias("content")).write.mode("overwrite").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").csv(path)


def write_report(table: DataFrame, path: str) -> None:
    """One JSON document per row."""
    table.select(F.to_json(F.struct(*table.columns)).alias("value")).write.mode("overwrite").text(path)


def append_provenance(ingested: DataFrame, path: str, *, name: str, media_type: str, role: str, source: str,
                      source_url: str | None = None, collected_before: str | None = None, seed: int = 34) -> None:
    """One row that says where an ingested set came from and how much was kept."""
    row = ingested.agg(F.count(F.lit(1)).alias("n_ingested"), F.count_distinct("source_file").alias("n_sources")).select(
        F.lit(name).alias("name"), F.lit("synthetic" if media_type == "fake" else media_type).alias("media_type"), F.lit(role).alias("role"),
        F.lit(source).alias("source"), F.lit(source_url).cast("string").alias("source_url"),
        F.lit(collected_before).cast("string").alias("collected_before"), F.current_timestamp().alias("retrieved_at"), "n_ingested",
        "n_sources", F.lit(seed).alias("seed"))
    row.write.mode("append").json(path)
