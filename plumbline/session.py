"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plumbline", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on and UTC time. ``master`` and partitions stay the cluster's unless given."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Python workers started from now on find this package where it isn't installed."""
    top = str(Path(__file__).resolve().parents[1])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if top not in path.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{path}:{top}".strip(":")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        top = tempfile.mkdtemp(prefix="plumbline-checkpoints-")
        sc.setCheckpointDir(top)
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike one held in executor storage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that one partition of a table of links, labels or keys holds.
ROWS_PER_PART = 200_000


def parts_for(rows: int, each: int = ROWS_PER_PART) -> int:
    """Partitions that a table of so many short rows needs."""
    return max(1, -(-rows // each))


def settle(df: DataFrame, each: int = ROWS_PER_PART) -> DataFrame:
    """``cut_lineage`` for a table of short rows, read back in as many partitions as its counted rows need: what follows then
    writes files for few tasks where the table is small, whatever the number of shuffle partitions."""
    t = cut_lineage(df)
    return t.coalesce(parts_for(t.count(), each))
