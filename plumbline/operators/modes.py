"""Audit modes: each turns scored rows into ledger rows, which are united, compared with the last ledger and appended.

A ledger row is one measurement: what was measured (mode, test, split, key), on how many rows, its headline value with
all metrics beside it, and a verdict.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions import ranking as R
from plumbline.operators import audit as A
from plumbline.operators import boosting as T
from plumbline.operators import evaluation as E
from plumbline.operators import ledger as L
from plumbline.operators import sampling as W
from plumbline.operators import units as U
from plumbline.session import cut_lineage

SUITE_VERSION = 1
COLUMNS = ("mode", "test", "split", "key", "key_str", "n", "verdict", "headline", "value", "higher_is_bad", "metrics")


def measured(df: DataFrame, mode: str, test: str | Column, headline: str, verdict: Column | str, *, split: Column | str = "all",
             key: Mapping[str, Column] | None = None, n: str = "n", metrics: Sequence[str] = (), higher_is_bad: bool = True) -> DataFrame:
    """Ledger rows from a table with one measurement per row; ``headline`` and ``metrics`` are its columns."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    keys = F.create_map(*[c for k, v in (key or {}).items() for c in (F.lit(k), v.cast("string"))]) if key else F.create_map()
    keys = keys.cast("map<string,string>")
    values = F.create_map(*[c for m in (headline, *metrics) for c in (F.lit(m), F.col(m).cast("double"))])
    where = F.coalesce(lit(split), F.lit("unknown"))
    return df.select(
        F.lit(mode).alias("mode"), lit(test).alias("test"), where.alias("split"), keys.alias("key"),
        L.key_string(F.lit(mode), lit(test), where, keys).alias("key_str"), F.col(n).cast("long").alias("n"), lit(verdict).alias("verdict"),
        F.lit(headline).alias("headline"), F.col(headline).cast("double").alias("value"), F.lit(higher_is_bad).alias("higher_is_bad"), values.alias("metrics"))


def _united(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metadata_rows(rows: DataFrame, numeric: Sequence[str] = A.NUMERIC, categorical: Sequence[str] = A.CATEGORICAL) -> DataFrame:
    """What each metadata column alone says about the label, and each split's category prior."""
    single = A.feature_aucs(rows, numeric, categorical)
    prior = E.mutual_information(rows, "split", "category", "label")
    return _united([
        measured(single, "metadata", "M2_feature_auc", "auc", F.col("verdict"), key={"feature": F.col("feature")}),
        measured(prior, "metadata", "M5_category_prior", "worst_prior", L.bucket(F.col("worst_prior"), "category_prior"), split=F.col("split"),
                 metrics=["mi_bits"])])


VAL_SPLITS = ("val_id", "val_xgen", "val_stress")


def metadata_probes(rows: DataFrame, numeric: Sequence[str] = A.NUMERIC, categorical: Sequence[str] = A.CATEGORICAL, *, block: str = "dataset",
                    folds: int = 5, seed: int = 34, shape: T.Shape = T.Shape(), only: Sequence[str] = ()) -> DataFrame:
    """One boosted fit for all probes of the metadata mode, or those named in ``only``, its rows scored: keep columns split and label, and ``oof_`` columns.

    ``blocked`` keeps blocks whole, ``naive`` doesn't, ``val`` learns on train and scores the validation splits, and where both
    category columns are there, ``raw`` and ``fixed`` see one of them beside the rest. Rows without a block are not probed.
    """
    blocks = W.blocked_folds(rows, folds, block).select(F.col("block").alias(block), F.col("fold").alias("_blocked"))
    r = W.naive_folds(rows, folds, seed).withColumnRenamed("fold", "_naive").join(blocks, block)
    both = {"content_category", "content_category_fixed"} <= set(rows.columns)
    plain = A.probe_features(rows, numeric, categorical)
    features, sets = dict(plain), {}
    for name, column in (("raw", "content_category"), ("fixed", "content_category_fixed")) if both else ():
        if only and name not in only:
            continue
        own = A.probe_features(rows, [], [column])
        features |= own
        sets[name] = (*plain, *own)
    y, blocked = F.col("label"), F.col("_blocked")
    val = F.when(F.col("split") == "train", 1).when(F.col("split").isin(*VAL_SPLITS), 0)
    groups = {"blocked": T.Group(y, blocked, tuple(plain), folds), "naive": T.Group(y, F.col("_naive"), tuple(plain), folds),
              "val": T.Group(y, val, tuple(plain), 1), **{k: T.Group(y, blocked, f, folds) for k, f in sets.items()}}
    groups = {k: groups[k] for k in only} if only else groups
    return T.out_of_fold(r, features, groups, ["split", "label"], shape)


def metadata_probe_rows(scored: DataFrame) -> DataFrame:
    """Ledger rows of ``metadata_probes``: M1 the label from metadata across blocks, M3 what memory of blocks adds, M4 what the validation
    splits inherit, M6 what corrected categories change. Undefined measurements warn in M1 and are left out elsewhere; M3, M4 and M6 are
    left out where their probes were not asked for."""
    names = [c[4:] for c in scored.columns if c.startswith("oof_")]
    res = A.probe_results(scored, {k: "label" for k in names if k != "val"})
    of = lambda k, c="auc": F.max(F.when(F.col("probe") == k, F.col(c)))
    wide = cut_lineage(res.agg(F.max("n").alias("n"), *[of(k).alias(f"auc_{k}") for k in names if k != "val"]))
    m1 = res.filter("probe = 'blocked'")
    parts = [measured(m1, "metadata", "M1_metadata_probe", "auc", A.probe_bucket("metadata_auc"), metrics=["ceiling", "coverage"])]
    if "naive" in names:
        m3 = wide.withColumn("memorisation_gap", F.col("auc_naive") - F.col("auc_blocked"))
        parts.append(measured(m3.filter("memorisation_gap IS NOT NULL"), "metadata", "M3_blocking_gap", "memorisation_gap", "ok", metrics=["auc_blocked", "auc_naive"]))
    if "val" in names:
        val = R.rank_auc(scored.filter(F.col("split").isin(*VAL_SPLITS)), ["split"], "oof_val", "label").filter("auc IS NOT NULL").withColumnRenamed("auc", "auc_val")
        m4 = val.withColumn("auc_blocked", wide.select("auc_blocked").scalar()).withColumn("excess", F.col("auc_val") - F.col("auc_blocked"))
        parts.append(measured(m4.filter("excess IS NOT NULL"), "metadata", "M4_val_inheritance", "excess", L.bucket(F.col("excess"), "val_inherit"), split=F.col("split"),
                              metrics=["auc_val", "auc_blocked"]))
    if "fixed" in names:
        m6 = wide.withColumn("delta", F.col("auc_fixed") - F.col("auc_raw"))
        parts.append(measured(m6.filter("delta IS NOT NULL"), "metadata", "M6_override_efficacy", "delta", "ok", metrics=["auc_raw", "auc_fixed"]))
    return _united(parts)


def error_probe(rows: DataFrame, numeric: Sequence[str] = A.NUMERIC, categorical: Sequence[str] = A.CATEGORICAL, *, block: str = "dataset", folds: int = 5,
                splits: Sequence[str] = (), shape: T.Shape = T.Shape()) -> DataFrame:
    """(split, wrong, oof_wrong, and ``oof_wrong_<split>`` for each of ``splits``): are the classifier's errors readable from metadata?

    ``rows`` has margin, label and split. One boosted fit; a split's own probe sees rows of that split only, on the same folds of blocks.
    """
    r = rows.withColumn("wrong", ((F.col("margin") > 0) != (F.col("label") == 1)).cast("int"))
    r = r.join(W.blocked_folds(rows, folds, block).select(F.col("block").alias(block), F.col("fold").alias("_blocked")), block)
    features = A.probe_features(rows, numeric, categorical)
    wrong, fold = F.col("wrong"), F.col("_blocked")
    groups = {"wrong": T.Group(wrong, fold, tuple(features), folds)}
    groups |= {f"wrong_{s}": T.Group(F.when(F.col("split") == s, wrong), fold, tuple(features), folds) for s in splits}
    return T.out_of_fold(r, features, groups, ["split", "wrong"], shape)


def error_rows(scored: DataFrame, splits: Sequence[str], least: int = 30) -> DataFrame:
    """Ledger rows of ``error_probe`` (S8): one for all rows, and one for each split with ``least`` right and wrong rows or more."""
    cols = {"wrong": "wrong", **{f"wrong_{s}": f"_{s}" for s in splits}}
    own = scored.select("*", *[F.when(F.col("split") == s, F.col("wrong")).alias(f"_{s}") for s in splits])
    res = A.probe_results(own, cols).withColumn("split", F.when(F.col("probe") == "wrong", "all").otherwise(F.expr("substr(probe, 7)")))
    numbers = (F.count(F.lit(1)).alias("_n"), F.sum("wrong").alias("_w"), F.avg(F.col("wrong").cast("double")).alias("error_rate"))
    size = scored.groupBy("split").agg(*numbers).unionByName(scored.groupBy(F.lit("all").alias("split")).agg(*numbers))
    res = res.join(size, "split").filter((F.col("split") == "all") | (F.col("_w") >= least) & (F.col("_n") - F.col("_w") >= least))
    return measured(res, "slices", "S8_error_predictability", "auc", A.probe_bucket("error_pred_auc"), split=F.col("split"), metrics=["error_rate", "coverage"])


#: Statistics that the row on single ones tells of.
TOP_STATS = 8


def tensor_rows(stats: DataFrame, rows: DataFrame, flags: Mapping[str, Column], names: Sequence[str], base: str, folds: int = 3,
                shape: T.Shape = T.Shape()) -> DataFrame:
    """Ledger rows of the tensors mode: T1 the label from statistics of the input, T2 nuisance flags that survive in them and
    tell the label, T3 what each variant of the input changes in T1, T4 the statistics that tell most alone."""
    results, single = A.tensor_probes(stats, rows, flags, names, base, folds, shape)
    results = cut_lineage(results)
    t1 = results.filter("probe = 'label'")
    t2 = A.survival(results, list(flags)).filter("label_auc IS NOT NULL")
    t3 = results.filter(F.startswith("probe", F.lit("label__"))).withColumn("auc_deploy", t1.select("auc").scalar())
    t3 = t3.withColumn("delta", F.col("auc") - F.col("auc_deploy"))
    t4 = single.filter("auc IS NOT NULL").orderBy(F.desc("auc"), "stat").limit(TOP_STATS)
    return _united([
        measured(t1, "tensors", "T1_rendered_probe", "auc", A.probe_bucket("tensor_auc"), split="sample", metrics=["ceiling", "coverage"]),
        measured(t2, "tensors", "T2_survival", "survival_auc", F.col("verdict"), split="sample", key={"nuisance": F.col("nuisance")}, metrics=["label_auc", "coverage"]),
        measured(t3, "tensors", "T3_laundering_price", "auc", "ok", split="sample", key={"variant": F.expr("substr(probe, 8)")}, metrics=["auc_deploy", "delta"]),
        measured(t4, "tensors", "T4_per_stat_auc", "auc", "ok", split="sample", key={"stat": F.col("stat")})])


def slice_rows(rows: DataFrame, floor: int = 50) -> DataFrame:
    """Scored rows by split: format and mode nuisance on reals, resolution, category gap, datasets, kinds."""
    flags = {"is_png": F.upper("file_format") == "PNG", "non_rgb": F.col("pil_mode") != "RGB"}
    nuisance = A.nuisance_aucs(rows, flags, floor=floor).filter("branch = 'fused'")
    test = F.when(F.col("flag") == "is_png", "S1_codec_nuisance").otherwise("S6_pilmode_nuisance")
    rho = R.spearman(rows.withColumn("_m", F.log(F.greatest("m_eval", F.lit(1e-6)))), ["split", "label"], "margin", "_m").filter(F.col("n") >= floor)
    rho = rho.withColumn("abs_rho", F.abs("rho"))
    tracks = F.when(F.col("label") == 0, L.bucket(F.col("abs_rho"), "margin_rho")).otherwise("ok")
    hit = ((F.col("margin") > 0) == (F.col("label") == 1)).cast("double")
    by_category = rows.groupBy("split", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("label") == 0, hit)).alias("_r"), F.avg(F.when(F.col("label") == 1, hit)).alias("_f"))
    gap = by_category.groupBy("split").agg(F.sum("n").alias("n"), F.coalesce(F.max(F.abs(F.col("_r") - F.col("_f"))), F.lit(0.0)).alias("worst_gap"))
    per = rows.groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("acc"))
    kinds = A.kind_deficit(rows).join(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split")
    return _united([
        measured(nuisance, "slices", test, "auc", F.col("verdict"), split=F.col("split")),
        measured(rho, "slices", "S2_resolution_rho", "abs_rho", tracks, split=F.col("split"), metrics=["rho"],
                 key={"class": F.when(F.col("label") == 0, "real").otherwise("fake")}),
        measured(gap, "slices", "S3_category_gap", "worst_gap", L.bucket(F.col("worst_gap"), "slice_gap"), split=F.col("split")),
        measured(per, "slices", "S4_dataset_acc", "acc", "ok", split=F.col("split"), key={"dataset": F.col("dataset")}, higher_is_bad=False),
        measured(kinds, "slices", "S5_kind", "deficit", F.col("verdict"), split=F.col("split"), metrics=["acc_real", "acc_synthetic", "acc_semisynthetic"])])


def pair_sides(rows: DataFrame, cap: int | None = None, seed: int = 34, least_real: int = 1) -> DataFrame:
    """All rows of mixed units, or ``cap`` a side, as in_pair; every row of another unit outside."""
    mixed = U.mixed_units(rows).filter(F.col("real_rows") >= least_real)
    return W.cap_sides(rows, mixed, cap, seed)


def pair_rows(paired: DataFrame, floor: int = 20) -> DataFrame:
    """Fakes inside mixed units against outside (P1), every unit's numbers (P_unit), confounds of the units' margin gap (P2), units with
    too many false alarms (P3), and one P3 row for all units, which is there when none is flagged as well."""
    counts = paired.agg(F.count(F.when(F.col("in_pair"), 1)).alias("n"))
    drop = A.pair_drop(paired)
    units = cut_lineage(A.pair_units(paired))
    flagged = cut_lineage(A.pair_fpr_flags(units, drop, floor))
    judged = units.join(flagged.select("split_unit", F.lit("warn").alias("_flag")), "split_unit", "left")
    overall = flagged.agg(F.count(F.lit(1)).alias("flagged_units")).withColumn("n", counts.scalar()).withColumn("global_fpr", drop.select("global_fpr").scalar())
    return _united([
        measured(drop.withColumn("n", counts.scalar()), "pairs", "P1_fake_drop", "drop", F.col("verdict"), metrics=["acc_in", "acc_out", "global_fpr"]),
        measured(judged, "pairs", "P_unit", "acc_fake", F.coalesce("_flag", F.lit("ok")), key={"unit": F.col("split_unit")}, higher_is_bad=False,
                 metrics=["margin_gap", "acc_real", "real_fpr", "png_delta", "log_res_ratio"]),
        measured(A.pair_confounds(units), "pairs", "P2_confound", "rho", F.col("verdict"), key={"against": F.col("against")}),
        measured(flagged, "pairs", "P3_unit_fpr", "real_fpr", "warn", key={"unit": F.col("split_unit")}, n="n_real"),
        measured(overall, "pairs", "P3_real_fpr", "flagged_units", F.when(F.col("flagged_units") > 0, "warn").otherwise("ok"), metrics=["global_fpr"])])


def intervention_rows(before: DataFrame, after: DataFrame, key: str, evidence_safe: Sequence[str] = ()) -> DataFrame:
    """Flips of every intervention and setting; the share of reals that turn decides."""
    f = A.flip_verdicts(A.flips(before, after, key), evidence_safe)
    return measured(f, "interventions", "I1_flips", "flip_real", F.col("verdict"), metrics=["flip_fake", "dp_real", "dp_fake"],
                    key={"intervention": F.col("intervention"), "setting": F.col("setting")})


def probe_rows(coverage: DataFrame) -> DataFrame:
    """Accuracy of every probe, kept for comparison with the ledger's last run."""
    return measured(coverage, "probes", "B1_probe_acc", "acc", "ok", split=F.col("mode"), higher_is_bad=False, metrics=["mean_p_fake"],
                    key={"type": F.col("type"), "dataset": F.col("dataset")})


def compare(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Measurements with delta, baseline and regressed against the ledger's last row of each key."""
    before = L.latest(ledger).withColumn("value", F.element_at("metrics", F.col("headline")))
    return L.regress(rows, before)


def publish(rows: DataFrame, ledger: DataFrame, path: str, tag: str, ts: Column | None = None) -> DataFrame:
    """Compare the united rows of a run with ``ledger``, append them once to ``path``, and return them worst first."""
    new = compare(rows, ledger).select(
        (ts if ts is not None else F.current_timestamp()).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(tag).alias("tag"),
        F.lit(SUITE_VERSION).alias("suite_version"), *[c for c in COLUMNS if c != "value"], "baseline", "delta", "regressed")
    L.append(new.select(*[F.col(f.name) for f in schemas._struct(schemas.LEDGER).fields]), path)
    return L.report_order(new)
