"""The append-only table of measurements: keys, latest rows, deltas, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import metrics as X

# Fixed values: (name, warn, hard) of every threshold.
THRESHOLDS = (
    ("metadata_auc", 0.70, 0.85),
    ("metadata_feature_auc", 0.65, None),
    ("val_inherit", 0.05, None),
    ("category_prior", 0.30, None),
    ("tensor_auc", 0.65, 0.80),
    ("survival_auc", 0.75, None),
    ("nuisance_auc", 0.65, 0.75),
    ("margin_rho", 0.30, 0.50),
    ("slice_gap", 0.25, None),
    ("kind_gap", 0.15, None),
    ("error_pred_auc", 0.70, None),
    ("flip_real", 0.10, 0.25),
    ("dp_real", 0.15, None),
    ("fake_drop", 0.20, None),
    ("pairs_drop", 0.15, None),
    ("pairs_confound_rho", 0.50, None),
    ("clique_fpr_mult", 2.0, None),
    ("regress_acc", 0.05, None),
    ("regress_auc", 0.05, None),
)
SEVERITY = ("hard", "warn", "ok")


def limits(name: str) -> tuple[float, float | None]:
    return next((w, h) for n, w, h in THRESHOLDS if n == name)


def bucket(value: Column, threshold: str, higher_is_bad: bool = True) -> Column:
    w, h = limits(threshold)
    return X.verdict(value, F.lit(w), F.lit(h).cast("double"), higher_is_bad)


def threshold_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(THRESHOLDS), "threshold string, warn double, hard double")


def key_string(mode: Column, test: Column, split: Column, key: Column) -> Column:
    """mode|test|split|k=v,... with keys in order. ``key`` is a map."""
    kv = F.transform(F.sort_array(F.map_entries(key)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws("|", mode, test, split, F.coalesce(F.array_join(kv, ","), F.lit("")))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every readable row; broken lines are dropped."""
    schema = schemas.LEDGER + ", _corrupt string"
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path))
    return raw.filter("_corrupt is null and key_str is not null").drop("_corrupt")


def latest(rows: DataFrame, keys=("key_str",), ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest row of every key; an aggregate, so a key with any number of rows is combined early."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, seq)).alias("_r"))
    return last.select(*keys, "_r.*")


def regress(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Delta against the last row of the key. A worse value turns ok into warn and nothing else.

    Both sides have key_str, headline and value; current has verdict and higher_is_bad. Without a
    previous row the measurement is a baseline.
    """
    prev = previous.select("key_str", F.col("headline").alias("_ph"), F.col("value").alias("_pv"), F.lit(True).alias("_seen"))
    j = current.join(prev, "key_str", "left")
    delta = F.when(F.col("headline") == F.col("_ph"), F.col("value") - F.col("_pv"))
    ranky = F.col("headline").contains("auc") | F.col("headline").contains("rho")
    tol = F.when(ranky, limits("regress_auc")[0]).otherwise(limits("regress_acc")[0])
    worse = F.coalesce(F.when(F.col("higher_is_bad"), F.col("delta") > tol).otherwise(F.col("delta") < -tol), F.lit(False))
    return (j.withColumn("baseline", F.col("_seen").isNull()).withColumn("delta", delta)
            .withColumn("regressed", worse & (F.col("verdict") == "ok"))
            .withColumn("verdict", F.when(F.col("regressed"), "warn").otherwise(F.col("verdict")))
            .drop("_ph", "_pv", "_seen"))


def report_order(rows: DataFrame) -> DataFrame:
    """Worst verdict first, then test and key."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("verdict"))
    return rows.orderBy("mode", rank, "test", "key_str")
