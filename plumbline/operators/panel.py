"""Comparing result tables: two runs of one classifier, or many models over many datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import metrics as X
from plumbline.functions import ranking as R
from plumbline.functions import scalar as S


def tally(psa: DataFrame, *keys: str) -> DataFrame:
    """Per dataset: n, exact hits, and hits when anything but real counts as fake."""
    n, t, p = F.col("n"), F.col("truth"), F.col("pred_label")
    right = F.when(t == "real", p == "real").otherwise(p != "real")
    return psa.groupBy(*keys, "truth", "dataset").agg(
        F.sum("n").alias("n"), F.sum(F.when(p == t, n).otherwise(0)).alias("exact"),
        F.sum(F.when(right, n).otherwise(0)).alias("right"))


def compare(reference: DataFrame, local: DataFrame, stream_marker: str) -> DataFrame:
    """Datasets in both tallies: accuracies in percent, their difference, z of two proportions."""
    a = tally(reference).select("dataset", F.col("truth").alias("truth"), F.col("n").alias("n_ref"), F.col("exact").alias("k_ref"), F.col("right").alias("b_ref"))
    b = tally(local).select("dataset", F.col("truth").alias("_t"), F.col("n").alias("n_local"), F.col("exact").alias("k_local"), F.col("right").alias("b_local"))
    j = a.join(b, "dataset")
    pct = lambda k, n: F.col(k) * 100.0 / F.col(n)
    return j.select(
        "dataset", "truth", S.provenance(F.col("dataset"), stream_marker, ignore_case=False).alias("provenance"),
        (F.col("truth") != F.col("_t")).alias("truth_differs"), "n_ref", "n_local", pct("k_ref", "n_ref").alias("acc_ref"),
        pct("k_local", "n_local").alias("acc_local"), pct("b_ref", "n_ref").alias("right_ref"), pct("b_local", "n_local").alias("right_local"),
        X.two_proportion_z(F.col("k_local"), F.col("n_local"), F.col("k_ref"), F.col("n_ref")).alias("z"),
    ).withColumn("delta", F.col("acc_local") - F.col("acc_ref"))


def comparison_summary(c: DataFrame, z_flag: float = 3.0, informative_below: float = 95.0) -> DataFrame:
    """One row over all datasets, with the part that can disagree at all counted on its own."""
    c = c.withColumn("_abs", F.abs("delta"))
    flag = F.abs("z") >= z_flag
    tell = (F.col("acc_ref") < informative_below) | (F.col("acc_local") < informative_below)
    s = c.agg(F.count(F.lit(1)).alias("datasets"), F.max("_abs").alias("max_delta"),
              F.when((F.count(F.lit(1)) > 2) & (F.stddev_samp("acc_ref") > 0) & (F.stddev_samp("acc_local") > 0),
                     F.corr("acc_ref", "acc_local")).alias("pearson"),
              F.count_if(flag).alias("flagged"), F.count_if(tell).alias("informative"), F.count_if(tell & flag).alias("informative_flagged"))
    med = R.exact_quantiles(c, [], "_abs", {"m": .5})
    return s.withColumn("median_delta", med.select("m").scalar())


def missing_names(names: DataFrame, *sides: DataFrame) -> DataFrame:
    """Requested names that are not in every side."""
    out = None
    for s in sides:
        gone = names.join(s.select(F.col("dataset").alias("name")).distinct(), "name", "left_anti")
        out = gone if out is None else out.union(gone)
    return out.distinct()


def deploy_prior_shares(psa: DataFrame, composition: dict[str, float], stream_marker: str) -> DataFrame:
    """Class shares of a run, raw and weighted so that provenance classes carry fixed parts."""
    t = psa.select("truth", "n", S.provenance(F.col("dataset"), stream_marker, ignore_case=False).alias("cls"))
    c = t.groupBy("cls", "truth").agg(F.sum("n").alias("n"))
    share = F.lit(None).cast("double")
    for k, v in composition.items():
        share = F.when(F.col("cls") == k, F.lit(float(v))).otherwise(share)
    # At most nine rows from here on.
    one = Window.partitionBy(F.lit(1))
    per = c.groupBy("cls").agg(F.sum("n").alias("_n")).withColumn("_s", share)
    per = per.withColumn("_w", F.col("_s") / F.sum("_s").over(one) * F.sum("_n").over(one) / F.col("_n"))
    j = c.join(per, "cls").filter(F.col("truth").isin(*S.KINDS))
    g = j.groupBy("truth").agg(F.sum("n").alias("raw"), F.sum(F.col("n") * F.col("_w")).alias("mass"))
    return g.select("truth", (F.col("raw") / F.sum("raw").over(one)).alias("raw_share"),
                    (F.col("mass") / F.sum("mass").over(one)).alias("weighted_share"))


def semi_given_fake(shares: DataFrame, column: str = "weighted_share") -> DataFrame:
    semi = F.sum(F.when(F.col("truth") == "semisynthetic", F.col(column)).otherwise(0.0))
    fake = F.sum(F.when(F.col("truth") != "real", F.col(column)).otherwise(0.0))
    return shares.agg((semi / fake).alias("semi_given_fake"))


def shared_by_all(t: DataFrame) -> DataFrame:
    """Datasets every model has."""
    models = t.select(F.count_distinct("model")).scalar()
    return t.groupBy("dataset").agg(F.count_distinct("model").alias("_m")).filter(F.col("_m") == models).select("dataset")


def model_accuracy(psa: DataFrame) -> DataFrame:
    """(model, dataset, truth, n, exact, acc) in percent."""
    return tally(psa, "model").withColumn("acc", F.col("exact") * 100.0 / F.col("n"))


def _ranks(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Average rank of each model inside ``key``: as many rows per window as there are models."""
    w, tie = Window.partitionBy(key), Window.partitionBy(key, value)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(tie) - 1) / F.lit(2.0))


def rank_against_targets(local: DataFrame, reference: DataFrame, targets: DataFrame) -> DataFrame:
    """Spearman over models of every shared local dataset against every target and the pooled target.

    Inputs (model, dataset, truth, pred_label, n); ``targets(dataset)``. NULL when either side is constant.
    """
    ref = model_accuracy(reference).join(targets, "dataset", "left_semi")
    pooled = ref.groupBy("model").agg((F.sum("exact") * 100.0 / F.sum("n")).alias("acc")).withColumn("target", F.lit("POOLED"))
    t = ref.select("model", "acc", F.col("dataset").alias("target")).unionByName(pooled)
    t = _ranks(t.withColumn("_v", F.round("acc", 9)), "target", "_v", "_rt").select("model", "target", "_rt")
    loc = model_accuracy(local)
    loc = loc.join(shared_by_all(loc), "dataset", "left_semi").withColumn("_v", F.round("acc", 9))
    loc = _ranks(loc, "dataset", "_v", "_rl").select("model", "dataset", "truth", "acc", "_rl")
    j = loc.join(t, "model")
    same = (F.stddev_pop("_rl") == 0) | (F.stddev_pop("_rt") == 0)
    return j.groupBy("dataset", "truth", "target").agg(
        F.when(~same, F.corr("_rl", "_rt")).alias("rho"), (F.max("acc") - F.min("acc")).alias("range"))


def rank_table(pairs: DataFrame) -> DataFrame:
    """Best pooled agreement first."""
    return pairs.filter("target = 'POOLED'").orderBy(F.desc_nulls_last(F.round("rho", 9)), F.desc(F.round("range", 9)), "dataset")


def rank_candidates(pairs: DataFrame, min_range: float, min_rho: float = 0.8) -> DataFrame:
    return pairs.filter((F.col("target") == "POOLED") & (F.col("range") >= min_range) & (F.round("rho", 9) >= min_rho))
