"""File trees: dataset folders, image headers, archive members, labelled pools."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.sources import ranges as G

# The suffixes that count as images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
_IMAGE = r"(?i)\.(?:" + "|".join(IMAGE_SUFFIXES) + r")$"


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, length, modified) of every file below root. Contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select(_plain(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def dataset_dirs(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, iso_week, dir) of every folder with a dataset_info.json, directly below ``root`` or one
    week folder deeper. A week counts only where the top folder has no info file of its own."""
    base = root.rstrip("/")
    info = list_files(spark, base, "dataset_info.json").select(
        F.regexp_replace("path", "/dataset_info.json$", "").alias("dir"))
    rel = F.split(F.col("dir").substr(F.lit(len(base) + 2), F.length("dir")), "/")
    d = info.select("dir", F.get(rel, F.lit(0)).alias("dataset"), F.coalesce(F.get(rel, F.lit(1)), F.lit("")).alias("iso_week"), F.size(rel).alias("_n"))
    d = d.filter("_n <= 2 and dataset <> ''")
    tops = d.filter("_n = 1").select("dataset", F.lit(True).alias("_top"))
    return d.join(tops, "dataset", "left").filter("_n = 1 or _top is null").select("dataset", "iso_week", "dir")


def metadata_files(spark: SparkSession, dirs: DataFrame, root: str) -> DataFrame:
    """dirs with the whole text of their sample_metadata.json; unreadable JSON later gives no rows."""
    r = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "sample_metadata.json")
         .option("wholetext", "true").text(root).select(F.regexp_replace(_plain(F.input_file_name()), "/sample_metadata.json$", "").alias("dir"),
                                                        F.col("value").alias("text")))
    return dirs.join(r, "dir")


def image_pool(spark: SparkSession, root: str) -> DataFrame:
    """Images below root/real and root/fake: (path, dataset, label)."""
    f = list_files(spark, root).filter(F.col("path").rlike(_IMAGE))
    side = F.regexp_extract(F.col("path").substr(F.lit(len(root.rstrip("/")) + 2), F.length("path")), "^(real|fake)/", 1)
    return f.filter(side != "").select("path", side.alias("dataset"), F.when(side == "real", 0).otherwise(1).alias("label"))


def folder_items(spark: SparkSession, root: str, seed: int) -> DataFrame:
    """Images of a folder in a seeded order: (path, source_file, content, place)."""
    base = root.rstrip("/")
    name = base.rsplit("/", 1)[-1]
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    r = r.select(_plain(F.col("path")).alias("path"), "content").filter(F.col("path").rlike(_IMAGE))
    parent = F.regexp_extract(F.col("path").substr(F.lit(len(base) + 2), F.length("path")), "^(.*)/[^/]*$", 1)
    return r.withColumn("source_file", F.when(parent == "", name).otherwise(parent)).withColumn(
        "place", S.stable_fraction(F.col("path"), seed))


def zip_items(spark: SparkSession, path: str, seed: int, range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """Images inside zip archives: (archive, member, source_file, content, place). An archive's members are dealt to tasks by
    ranges of its directory; a task reads its own range and holds one member at a time."""
    r = G.zip_members(spark, path, tuple(f".{s}" for s in IMAGE_SUFFIXES), range_bytes)
    name = F.regexp_replace(F.regexp_extract("archive", "([^/]*)$", 1), r"\.[^.]*$", "")
    parent = F.regexp_extract("member", "^(.*)/[^/]*$", 1)
    return r.select("archive", "member", F.when(parent == "", name).otherwise(parent).alias("source_file"), "content").withColumn(
        "place", S.stable_fraction(F.col("member"), seed))


HEAD_BYTES = 16_384
HEADER = "path string, width bigint, height bigint, file_format string, pil_mode string, file_bytes bigint"


def probe_headers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(readable, rejected) images below root, from their headers: size, format, colour mode, bytes.

    Files are listed without their contents and opened by the workers, which read HEAD_BYTES of each, and segment heads of JPEG
    with long metadata. For a store that only Spark reads, give ``probe_contents`` a table with the contents.
    """
    probed = G.headers(list_files(spark, root))
    ok = (F.col("width") > 0) & (F.col("height") > 0)
    return probed.filter(ok).drop("read_bytes"), probed.filter(~ok).select("path")


def probe_contents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``probe_headers`` for a table (path, length, content). First only the head of each file leaves the JVM; files whose size
    is not in it, as in JPEG behind long metadata, are read whole in a second pass."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from plumbline.sources.headers import image_header
        for pdf in batches:
            got = [image_header(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "width": [g[0] for g in got], "height": [g[1] for g in got],
                                "file_format": [g[2] for g in got], "pil_mode": [g[3] for g in got], "file_bytes": pdf["length"]})
    ok = (F.col("width") > 0) & (F.col("height") > 0)
    head = files.withColumn("content", F.substring("content", 1, HEAD_BYTES)).mapInPandas(run, HEADER)
    open_ = files.filter(F.length("content") > HEAD_BYTES).join(head.filter(~ok).select("path"), "path", "left_semi")
    whole = open_.select("path", "length", "content").mapInPandas(run, HEADER)
    probed = head.join(whole.select("path"), "path", "left_anti").unionByName(whole)
    return probed.filter(ok), probed.filter(~ok).select("path")
