"""Is the label, or the classifier's error, readable from things it should not be readable from?"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.operators import boosting as T
from plumbline.operators import ledger as L
from plumbline.session import cut_lineage, ship_package

# The metadata columns that are probed, and the accuracies that call a type weak or strong.
NUMERIC = ("width", "height", "min_side", "max_side", "aspect", "megapixels", "bytes_per_pixel", "file_bytes", "m_eval")
CATEGORICAL = ("ext", "file_format", "pil_mode", "source_format")
WEAK_BELOW, STRONG_FROM = 0.80, 0.92


def target_encode(rows: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(column, value) -> mean label and rows, all columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")
    return rows.select(label, pairs).groupBy("s.feature", "s.value").agg(
        F.avg(label).alias("lift"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("fake"))


def feature_aucs(rows: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Direction-free AUC of every single feature for the label. A category scores as its mean label,
    so its AUC follows from the encoded table without another look at the rows."""
    numeric, categorical = ([c for c in cs if c in rows.columns] for cs in (numeric, categorical))
    nums = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("score")) for c in numeric])).alias("s")
    counted = rows.select("label", nums).filter("s.score is not null").groupBy("s.feature", "s.score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    if categorical:
        enc = target_encode(rows, categorical).groupBy("feature", F.col("lift").alias("score")).agg(
            F.sum("fake").cast("bigint").alias("pos"), F.sum(F.col("n") - F.col("fake")).cast("bigint").alias("neg"))
        counted = counted.unionByName(enc)
    placed = R.running_total(counted, ["feature"], "score", ["neg"])
    s = placed.groupBy("feature").agg(F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("u"),
                                      F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    auc = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p").cast("double") * F.col("q")))
    out = s.select("feature", (F.col("p") + F.col("q")).alias("n"), R.folded(auc).alias("auc"))
    return out.withColumn("verdict", L.bucket(F.col("auc"), "metadata_feature_auc"))


# ---- out-of-fold probes -------------------------------------------------------------------------

def probe_frame(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], top_k: int = 12) -> DataFrame:
    """Rows with a feature vector: log1p numbers and one-hots of each category's top values. The
    vocabulary, at most top_k values per column, is the only thing the driver sees."""
    from pyspark.ml.functions import array_to_vector
    vocab = [(r["feature"], r["value"]) for r in R.top_values(rows, categorical, top_k).orderBy("feature", "place").collect()]
    nums = [F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in numeric]
    hots = [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) for c, v in vocab]
    return rows.withColumn("features", array_to_vector(F.array(*nums, *hots)))


def probe_features(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], top_k: int = 12) -> dict[str, Column]:
    """Features of boosted probes by name: numbers as they are, and whether a category is one of its column's top values. The
    vocabulary, at most top_k values per column, is the only thing the driver sees."""
    vocab = [(r["feature"], r["value"]) for r in R.top_values(rows, categorical, top_k).orderBy("feature", "place").collect()]
    hots = {f"{c}={v}": (F.col(c).cast("string") == v).cast("int") for c, v in vocab}
    return {c: F.col(c).cast("double") for c in numeric if c in rows.columns} | {k: F.coalesce(c, F.lit(0)) for k, c in hots.items()}


def probe_results(scored: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """(probe, n, auc, coverage, ceiling, unmeasurable) of all probes ``oof_<probe>`` at once, each against its target column.

    Coverage is the share of rows with a target that were scored; an undefined AUC or coverage below 99% is unmeasurable.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), F.col(f"`oof_{k}`").alias("oof"), F.col(y).cast("int").alias("y")) for k, y in targets.items()])).alias("s")
    rows = scored.select(each).select("s.*").filter("y IS NOT NULL")
    cover = rows.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("oof").isNotNull().cast("double")).alias("coverage"))
    out = cover.join(R.rank_auc(rows, ["probe"], "oof", "y").select("probe", "auc"), "probe", "left")
    return out.withColumn("ceiling", S.auc_ceiling(F.col("auc"))).withColumn("unmeasurable", F.col("auc").isNull() | (F.col("coverage") < 0.99))


def probe_bucket(threshold: str) -> Column:
    """Verdict of a row of ``probe_results``: what cannot be measured cannot pass and warns."""
    return F.when(F.col("unmeasurable"), "warn").otherwise(L.bucket(F.col("auc"), threshold))


#: Trees of a boosted probe.
PROBE_ROUNDS = 200


def _numeric_frame(rows: DataFrame, numeric: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return rows.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in numeric])))


def _probe(kind: str, target: str):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol=target, maxIter=PROBE_ROUNDS, seed=34)
    if kind != "logistic":
        raise ValueError(f"unknown probe {kind!r}; have logistic and gbt")
    return LogisticRegression(featuresCol="features", labelCol=target, maxIter=20, tol=1e-4, regParam=1e-4)


def oof_scores(frame: DataFrame, target: str, fold: str, folds: int, kind: str = "logistic") -> DataFrame:
    """Each row scored by a model that never saw its fold. A fold whose training side holds one
    class stays unscored (NULL)."""
    from pyspark.ml.functions import vector_to_array
    # Read once per fold and iteration, so the narrow table of features is cut from its lineage.
    frame = cut_lineage(frame.select("image_id", target, fold, "features"))
    sides = {(r[fold], r[target]): r["n"] for r in frame.groupBy(fold, target).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for f in range(folds):
        test = frame.filter(F.col(fold) == f)
        classes = {t for (g, t) in sides if g != f}
        if len(classes) < 2:
            part = test.withColumn("oof", F.lit(None).cast("double"))
        else:
            model = _probe(kind, target).fit(frame.filter(F.col(fold) != f))
            part = model.transform(test).withColumn("oof", vector_to_array("probability")[1])
        part = part.select("image_id", target, "oof")
        out = part if out is None else out.unionByName(part)
    return cut_lineage(out)


def fit_and_score(train: DataFrame, test: DataFrame, target: str = "label", kind: str = "logistic") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    scored = _probe(kind, target).fit(train.select(target, "features")).transform(test)
    return cut_lineage(scored.withColumn("oof", vector_to_array("probability")[1]).drop("rawPrediction", "probability"))


def probe_verdict(oof: DataFrame, target: str, threshold: str) -> DataFrame:
    """AUC and coverage; an undefined AUC or coverage below 99% cannot pass and warns."""
    a = R.rank_auc(oof, [], "oof", target)
    cov = oof.agg(F.avg(F.col("oof").isNotNull().cast("double"))).scalar()
    v = a.select(F.col("auc"), F.coalesce(cov, F.lit(0.0)).alias("coverage"))
    lost = F.col("auc").isNull() | (F.col("coverage") < 0.99)
    return (v.withColumn("ceiling", S.auc_ceiling(F.col("auc"))).withColumn("unmeasurable", lost)
            .withColumn("verdict", F.when(lost, "warn").otherwise(L.bucket(F.col("auc"), threshold))))


# ---- slices -------------------------------------------------------------------------------------

def nuisance_aucs(rows: DataFrame, flags: Mapping[str, Column], by: str = "split", floor: int = 50) -> DataFrame:
    """Among reals, does the fake probability follow a nuisance flag? Fused and per branch, all flags
    at once: (by, flag, branch) -> folded AUC. Groups of ``floor`` rows or fewer are left out."""
    reals = rows.filter("label = 0")
    flag = F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), c.cast("int").alias("on")) for n, c in flags.items()])).alias("f")
    kind = "array<struct<branch:string,m:double>>"  # names given inside a lambda are not always kept
    branches = F.transform("d", lambda x, i: F.struct(F.concat(F.lit("branch_"), i.cast("string")), x)).cast(kind)
    allm = F.concat(F.array(F.struct(F.lit("fused"), F.col("margin"))).cast(kind), branches)
    r = reals.select(by, flag, F.explode(allm).alias("b")).select(by, "f.flag", "f.on", "b.branch", "b.m")
    a = R.rank_auc(r, [by, "flag", "branch"], "m", "on")
    a = a.filter((F.col("n") > floor) & F.col("auc").isNotNull()).withColumn("auc", R.folded(F.col("auc")))
    return a.withColumn("verdict", F.when(F.col("branch") == "fused", L.bucket(F.col("auc"), "nuisance_auc")))


def branch_rhos(rows: DataFrame, by: Sequence[str], against: str) -> DataFrame:
    """Spearman of each branch margin with a column, per slice and branch."""
    r = rows.select(*by, against, F.posexplode("d").alias("branch", "m"))
    return R.spearman(r, [*by, "branch"], "m", against)


def kind_deficit(rows: DataFrame, by: str = "split") -> DataFrame:
    hit = ((F.col("margin") > 0) == (F.col("label") == 1)).cast("double")
    a = rows.groupBy(by).agg(*[F.avg(F.when(F.col("kind") == k, hit)).alias(f"acc_{k}") for k in S.KINDS])
    gap = F.when(F.col("acc_semisynthetic").isNotNull(), F.coalesce("acc_synthetic", F.lit(0.0)) - F.col("acc_semisynthetic"))
    return a.withColumn("deficit", gap).withColumn("verdict", L.bucket(F.col("deficit"), "kind_gap"))


# ---- pairs --------------------------------------------------------------------------------------

def pair_units(rows: DataFrame) -> DataFrame:
    """Per mixed unit: margin gap, accuracies, false positive rate of reals, PNG share difference, log
    resolution ratio. Input has in_pair, split_unit, label, margin, file_format, min_side."""
    r = rows.filter("in_pair")
    hit = ((F.col("margin") > 0) == (F.col("label") == 1)).cast("double")
    png = (F.upper("file_format") == "PNG").cast("double")
    side = lambda c, v: F.avg(F.when(F.col("label") == v, c))
    u = r.groupBy("split_unit").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") == 0, 1)).alias("n_real"), F.count(F.when(F.col("label") == 1, 1)).alias("n_fake"),
        (side(F.col("margin"), 1) - side(F.col("margin"), 0)).alias("margin_gap"), side(hit, 0).alias("acc_real"), side(hit, 1).alias("acc_fake"),
        side((F.col("margin") > 0).cast("double"), 0).alias("real_fpr"), (side(png, 1) - side(png, 0)).alias("png_delta"))
    med = R.exact_quantiles(r, ["split_unit", "label"], "min_side", {"m": .5}).groupBy("split_unit").agg(
        F.max(F.when(F.col("label") == 1, F.col("m"))).alias("_f"), F.max(F.when(F.col("label") == 0, F.col("m"))).alias("_r"))
    ratio = F.log(F.greatest(F.col("_f"), F.lit(1.0)) / F.greatest(F.col("_r"), F.lit(1.0)))
    return u.filter("n_real > 0 and n_fake > 0").join(med, "split_unit").withColumn("log_res_ratio", ratio).drop("_f", "_r")


def pair_drop(rows: DataFrame) -> DataFrame:
    """Fake accuracy inside mixed units against outside, and the global real FPR outside."""
    hit = (F.col("margin") > 0).cast("double")
    fake, real = F.col("label") == 1, F.col("label") == 0
    a = rows.agg(F.avg(F.when(F.col("in_pair") & fake, hit)).alias("acc_in"), F.avg(F.when(~F.col("in_pair") & fake, hit)).alias("acc_out"),
                 F.avg(F.when(~F.col("in_pair") & real, hit)).alias("global_fpr"))
    return a.withColumn("drop", F.col("acc_out") - F.col("acc_in")).withColumn("verdict", L.bucket(F.col("drop"), "pairs_drop"))


def pair_confounds(units: DataFrame) -> DataFrame:
    """Does the margin gap of units follow their format or resolution difference? Needs four units."""
    # One row per unit, read many times by the ranks.
    units = cut_lineage(units.select("png_delta", "log_res_ratio", "margin_gap"))
    two = units.select(F.explode(F.array(F.struct(F.lit("png_delta").alias("against"), F.col("png_delta").alias("x")),
                                         F.struct(F.lit("log_res_ratio").alias("against"), F.col("log_res_ratio").alias("x")))).alias("s"), "margin_gap")
    r = R.spearman(two.select("s.against", "s.x", "margin_gap"), ["against"], "x", "margin_gap").filter("n >= 4")
    return r.withColumn("verdict", L.bucket(F.abs("rho"), "pairs_confound_rho"))


def pair_fpr_flags(units: DataFrame, drop: DataFrame, floor: int = 20, least: float = 0.05) -> DataFrame:
    """Units whose reals are called fake far more often than elsewhere."""
    g = drop.select("global_fpr").scalar()
    much = F.when(F.coalesce(g, F.lit(0.0)) > 0, F.col("real_fpr") / g > L.limits("clique_fpr_mult")[0]).otherwise(F.col("real_fpr") > 0)
    return units.filter((F.col("n_real") >= floor) & (F.col("real_fpr") > least) & much).select("split_unit", "real_fpr", "n_real")


# ---- interventions ------------------------------------------------------------------------------

def flips(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per intervention and setting: accuracy before and after, flips, mean and mean absolute change
    of probability, on reals and on fakes. ``after`` has intervention, setting, key, margin."""
    b = before.select(key, "y", F.col("margin").alias("m0"))
    a = after.select("intervention", "setting", key, F.col("margin").alias("m1"))
    j = b.join(a, key)
    dp = S.sigmoid(F.col("m1")) - S.sigmoid(F.col("m0"))
    hit = lambda m: ((F.col(m) > 0) == (F.col("y") == 1)).cast("double")
    flip = ((F.col("m0") > 0) != (F.col("m1") > 0)).cast("double")
    aggs = []
    for name, v in (("real", 0), ("fake", 1)):
        for tag, c in (("acc_before", hit("m0")), ("acc_after", hit("m1")), ("flip", flip), ("dp", dp), ("adp", F.abs(dp))):
            aggs.append(F.avg(F.when(F.col("y") == v, c)).alias(f"{tag}_{name}"))
    return j.groupBy("intervention", "setting").agg(F.count(F.lit(1)).alias("n"), *aggs)


def flip_verdicts(f: DataFrame, evidence_safe: Sequence[str] = ()) -> DataFrame:
    """Flip rate of reals decides; a large mean change warns; for interventions that leave the
    evidence in place a collapse of fakes warns too."""
    v = L.bucket(F.col("flip_real"), "flip_real")
    drop = F.col("acc_before_fake") - F.col("acc_after_fake")
    warn = (L.bucket(F.col("adp_real"), "dp_real") != "ok") | (
        F.col("intervention").isin(*evidence_safe) & (L.bucket(drop, "fake_drop") != "ok"))
    return f.withColumn("verdict", F.when((v == "ok") & warn, "warn").otherwise(v))


def branch_attribution(before: DataFrame, after: DataFrame, key: str, worst: int = 3) -> DataFrame:
    """For the settings that move reals most: flips and mean change of every branch."""
    f = flips(before, after, key).withColumn("_bad", F.col("flip_real") + F.col("adp_real"))
    pick = f.orderBy(F.desc(F.round("_bad", 9)), "intervention", "setting").limit(worst).select("intervention", "setting")
    b = before.filter("y = 0").select(key, F.col("d").alias("d0"))
    a = after.join(pick, ["intervention", "setting"], "left_semi").select("intervention", "setting", key, F.col("d").alias("d1"))
    j = b.join(a, key).select("intervention", "setting", F.posexplode(F.arrays_zip("d0", "d1")).alias("branch", "z"))
    return j.groupBy("intervention", "setting", "branch").agg(
        F.avg(((F.col("z.d0") > 0) != (F.col("z.d1") > 0)).cast("double")).alias("flip_real"),
        F.avg(F.abs(S.sigmoid(F.col("z.d1")) - S.sigmoid(F.col("z.d0")))).alias("adp_real"))


Transform = Callable[[Column, Column], Column]

TEXT_INTERVENTIONS: dict[str, list[tuple[str, Transform]]] = {
    "lower": [("all", lambda text, row: F.lower(text))],
    "no_digits": [("all", lambda text, row: F.regexp_replace(text, "[0-9]", ""))],
    "spaces": [("one", lambda text, row: F.regexp_replace(text, " +", " "))],
    "repeated_lines": [("first", lambda text, row: F.array_join(F.array_distinct(F.split(text, "\n")), "\n"))],
}


def intervene(rows: DataFrame, key: str, column: str, registry: Mapping[str, list[tuple[str, Transform]]],
              wanted: Sequence[str]) -> DataFrame:
    """One row per (row, intervention, setting) with the changed column. A transform sees the value
    and the row's key, never the label: it takes two columns and no more."""
    unknown = sorted(set(wanted) - set(registry))
    if unknown:
        raise ValueError(f"unknown interventions {unknown}; have {sorted(registry)}")
    made = [F.struct(F.lit(n).alias("intervention"), F.lit(s).alias("setting"), fn(F.col(column), F.col(key)).alias(column))
            for n in wanted for s, fn in registry[n]]
    return rows.select(key, F.explode(F.array(*made)).alias("_s")).select(key, "_s.*")


# ---- probes -------------------------------------------------------------------------------------

def probe_coverage(scored: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe and mode: accuracy, accuracy per branch, mean probability. ``probes(type, name)``."""
    hit = lambda m: ((m > 0) == (F.col("y") == 1)).cast("double")
    j = scored.join(probes.withColumnRenamed("name", "dataset"), "dataset")
    return j.groupBy("type", "dataset", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit(F.col("margin"))).alias("acc"), F.avg(S.sigmoid(F.col("margin"))).alias("mean_p_fake"),
        *[F.avg(hit(F.element_at("d", i + 1))).alias(f"acc_branch_{i}") for i in range(3)])


def type_status(types: DataFrame, coverage: DataFrame) -> DataFrame:
    """weak / ok / strong by the worst deploy accuracy of a type's probes; untested without any."""
    worst = coverage.filter("mode = 'deploy'").groupBy("type").agg(F.min("acc").alias("worst"))
    status = (F.when(F.col("worst").isNull(), "untested").when(F.col("worst") < WEAK_BELOW, "weak")
              .when(F.col("worst") >= STRONG_FROM, "strong").otherwise("ok"))
    return types.join(worst, "type", "left").select("type", "worst", status.alias("status"))


# ---- numeric-array statistics -------------------------------------------------------------------

def array_stats(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Mean, spread, extremes and mean absolute step of a numeric array, inside the JVM."""
    a = F.transform(column, lambda x: x.cast("double"))
    n = F.size(column)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    r = rows.select(key, a.alias("_a"), n.alias("_n"), (total / n).alias("mean"))
    var = F.aggregate("_a", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("_n")
    steps = F.zip_with(F.slice("_a", F.lit(2), F.col("_n") - 1), F.slice("_a", F.lit(1), F.col("_n") - 1), lambda x, y: F.abs(x - y))
    edge = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.col("_n") - 1, F.lit(1))
    return r.select(key, "mean", F.sqrt(var).alias("std"), F.array_min("_a").alias("low"), F.array_max("_a").alias("high"), edge.alias("edge"))


#: What ``word_stats`` gives, the bytes of text that a task counts in at a time, and the blanks between words.
WORD_STATS = ("mean", "std", "low", "high", "edge")
TEXT_AT_ONCE = 1_000_000
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_lengths(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in code points of all words of texts of ``size`` bytes that lie in ``data`` one after another, and the words of each text.

    A text is cut at its runs of blanks; what is before the first and after the last counts, and may be empty."""
    end = np.cumsum(size)
    blank = BLANK[data]
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    first = (end - size)[size > 0]
    opens[first] = blank[first]
    at = np.flatnonzero(opens)
    words = np.diff(np.searchsorted(at, end), prepend=0) + 1
    # A word ends where a run of blanks opens or the text ends.
    ends = np.insert(at, np.cumsum(words - 1), end)
    chars = np.concatenate([[0], np.cumsum(~blank & ((data & 0xC0) != 0x80))])
    return np.diff(chars[ends], prepend=0), words


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out = np.zeros((len(batch), len(WORD_STATS)))
        cuts = [0, *(np.flatnonzero(np.diff(ends[1:] // TEXT_AT_ONCE)) + 1), len(batch)] if len(batch) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            x, n = word_lengths(data[ends[a] : ends[b]], np.diff(ends[a : b + 1]))
            first, row = np.cumsum(n) - n, np.repeat(np.arange(b - a), n)
            mean = np.bincount(row, x) / n
            step = np.abs(np.diff(x, prepend=x[:1]))
            step[first] = 0
            std = np.sqrt(np.bincount(row, (x - mean[row]) ** 2) / n)
            out[a:b] = np.stack([mean, std, np.minimum.reduceat(x, first), np.maximum.reduceat(x, first), np.bincount(row, step) / np.maximum(n - 1, 1)], 1)
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), **{c: pa.array(out[:, k]) for k, c in enumerate(WORD_STATS)}})


def word_stats(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``array_stats`` of the lengths of a text's words, without an array of words or of lengths; null counts as an empty text, whose
    one word is empty. Sums go from left to right; nothing is shuffled."""
    ship_package(rows.sparkSession)
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    out = given.mapInArrow(_word_rows, f"key {kind}, " + ", ".join(f"{c} double" for c in WORD_STATS))
    return out.withColumnRenamed("key", key)


# Ends of the eight log-spaced bands of frequency, in cycles per step, and where low and high ones end and begin.
BAND_ENDS = tuple(0.01 * 70.0 ** (k / 8) for k in range(9))
LOW_TO, HIGH_FROM, LEVELS = 0.2, 0.35, 16
GRID_STATS = (*(f"band_{k}" for k in range(8)), "hf_lf", "blockiness", "edge_density", "entropy")


def frequencies(side: int) -> list[tuple[int, int, float]]:
    """(row wave, column wave, cycles per step) of the real Fourier transform of a side x side grid."""
    return [(u, v, math.hypot(min(u, side - u), v) / side) for u in range(side) for v in range(side // 2 + 1)]


def grid_stats(rows: DataFrame, key: str, column: str, side: int = 8) -> DataFrame:
    """Spectral bands, high/low ratio, blockiness at half-size tiles, mean step and entropy of a side x side grid, in
    built-in functions. A band without frequencies is 0."""
    waves, half = frequencies(side), side // 2
    cos, sin = (F.array(*[F.lit(f(2 * math.pi * k / side)) for k in range(side)]) for f in (math.cos, math.sin))
    at = F.sequence(F.lit(0), F.lit(side * side - 1))
    rows_, cols = (F.array(*[F.lit(w[i]) for w in waves]) for i in (0, 1))

    def power(k: Column) -> Column:
        turn = lambda i: ((F.get(rows_, k) * F.floor(i / side) + F.get(cols, k) * (i % side)) % side).cast("int")

        def part(wave: Column) -> Column:
            return F.aggregate(at, F.lit(0.0), lambda s, i: s + F.get("_c", i) * F.get(wave, turn(i)))
        return part(cos) * part(cos) + part(sin) * part(sin)

    def total(items: list[int], of: Column) -> Column:
        return sum((F.get(of, F.lit(i)) for i in items), F.lit(0.0))

    r = rows.select(key, F.transform(column, lambda x: x.cast("double")).alias("_a"))
    # The mean belongs to no band; without it a constant grid has no power at all.
    r = r.withColumn("_mean", F.aggregate("_a", F.lit(0.0), lambda s, x: s + x) / F.size("_a"))
    r = r.withColumn("_c", F.transform("_a", lambda x: x - F.col("_mean")))
    r = r.withColumn("_p", F.transform(F.sequence(F.lit(0), F.lit(len(waves) - 1)), power))
    bands = [[i for i, w in enumerate(waves) if lo <= w[2] < hi] for lo, hi in zip(BAND_ENDS, BAND_ENDS[1:], strict=False)]
    high, low = [i for i, w in enumerate(waves) if w[2] > HIGH_FROM], [i for i, w in enumerate(waves) if 0 < w[2] <= LOW_TO]
    a = lambda y, x: F.get("_a", F.lit(y * side + x))
    across = {x: [F.abs(a(y, x + 1) - a(y, x)) for y in range(side)] for x in range(side - 1)}
    down = {y: [F.abs(a(y + 1, x) - a(y, x)) for x in range(side)] for y in range(side - 1)}

    def mean(steps: dict[int, list[Column]], keep) -> Column:
        picked = [c for k, v in steps.items() if keep(k) for c in v]
        return sum(picked, F.lit(0.0)) / len(picked)
    edge = lambda k: (k + 1) % half == 0
    block = [mean(s, edge) / F.greatest(mean(s, lambda k: not edge(k)), F.lit(1e-9)) for s in (across, down)]
    lo, hi = F.array_min("_a"), F.array_max("_a")
    r = r.withColumn("_low", lo).withColumn("_width", F.greatest(hi - lo, F.lit(1e-12)))
    r = r.withColumn("_l", F.transform("_a", lambda x: F.least(F.floor((x - F.col("_low")) / F.col("_width") * LEVELS), F.lit(LEVELS - 1))))
    share = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.size(F.filter("_l", lambda x: x == k)) / F.lit(float(side * side)))
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(F.greatest(p, F.lit(1e-12))))
    return r.select(
        key, *[F.log1p(total(b, F.col("_p")) / max(len(b), 1)).alias(f"band_{k}") for k, b in enumerate(bands)],
        F.log1p(total(high, F.col("_p")) / F.greatest(total(low, F.col("_p")), F.lit(1e-9))).alias("hf_lf"), ((block[0] + block[1]) / 2).alias("blockiness"),
        ((mean(across, lambda k: True) + mean(down, lambda k: True)) / 2).alias("edge_density"), entropy.alias("entropy"))


def stat_aucs(stats: DataFrame, labels: DataFrame, key: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Folded AUC of every statistic for the label, per ``by`` (a variant column, say)."""
    j = stats.join(labels, key)
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("v")) for n in names])).alias("s")
    a = R.rank_auc(j.select(*by, "label", s).select(*by, "label", "s.stat", "s.v"), [*by, "stat"], "v", "label")
    return a.withColumn("auc", R.folded(F.col("auc")))


def variant_deltas(aucs: DataFrame, base: str) -> DataFrame:
    """How much each variant of the input moves the AUC of a statistic, against the ``base`` variant.
    ``aucs(variant, stat, auc)``."""
    b = aucs.filter(F.col("variant") == base).select("stat", F.col("auc").alias("auc_base"))
    j = aucs.filter(F.col("variant") != base).join(b, "stat")
    return j.select("variant", "stat", "auc", "auc_base", (F.col("auc") - F.col("auc_base")).alias("delta"))


def tensor_probes(stats: DataFrame, rows: DataFrame, flags: Mapping[str, Column], names: Sequence[str], base: str, folds: int = 3,
                  shape: T.Shape = T.Shape()) -> tuple[DataFrame, DataFrame]:
    """(results, marginals) of everything that statistics of the input can tell, from one boosted fit.

    ``stats(image_id, variant, <names>)`` has each item's statistics under every variant of the input, ``base`` being the one in use;
    ``rows`` has image_id, label and fold. Probes: ``label`` and every flag on the base statistics, ``label__<variant>`` on a variant's own.
    Results are those of ``probe_results`` with label_auc, the folded AUC of the flag itself; marginals are (stat, n, auc). A flag
    of one value is left out by the AUC it then lacks. Items without statistics of some variant are scored with missing values.
    The statistics are worked out once and written down.
    """
    stats = cut_lineage(stats)
    variants = sorted(r["variant"] for r in stats.select("variant").distinct().collect())
    wide = stats.groupBy("image_id").agg(*[F.max(F.when(F.col("variant") == v, F.col(n))).alias(f"{v}:{n}") for v in variants for n in names])
    r = rows.select("image_id", "label", "fold", *[c.cast("int").alias(f"is__{k}") for k, c in flags.items()]).join(wide, "image_id")
    features = {f"{v}:{n}": F.col(f"`{v}:{n}`") for v in variants for n in names}
    of = lambda v: tuple(f"{v}:{n}" for n in names)
    targets = {"label": "label", **{k: f"is__{k}" for k in flags}, **{f"label__{v}": "label" for v in variants if v != base}}
    groups = {k: T.Group(F.col(f"`{y}`"), F.col("fold"), of(k[7:] if k.startswith("label__") else base), folds) for k, y in targets.items()}
    kept = ["label", *[f"is__{k}" for k in flags]]
    scored = T.out_of_fold(r, features, groups, kept, shape)
    results = probe_results(scored, {k: f"`{y}`" for k, y in targets.items()})
    flag = F.explode(F.array(*[F.struct(F.lit(k).alias("probe"), F.col(f"`is__{k}`").alias("on")) for k in flags])).alias("s") if flags else None
    if flags:
        own = R.rank_auc(scored.select("label", flag).select("label", "s.*"), ["probe"], "on", "label").select("probe", R.folded(F.col("auc")).alias("label_auc"))
        results = results.join(own, "probe", "left")
    else:
        results = results.withColumn("label_auc", F.lit(None).cast("double"))
    plain = stats.filter(F.col("variant") == base).drop("variant")
    return results, stat_aucs(plain, rows.select("image_id", "label"), "image_id", names)


def survival(results: DataFrame, flags: Sequence[str]) -> DataFrame:
    """From ``tensor_probes``: can statistics of an item still tell a nuisance flag, and does the flag tell the label? Both
    means a live shortcut."""
    r = results.filter(F.col("probe").isin(list(flags)))
    live = ~F.col("unmeasurable") & (F.col("auc") > L.limits("survival_auc")[0]) & (F.col("label_auc") > L.limits("metadata_feature_auc")[0])
    r = r.withColumn("live", F.coalesce(live, F.lit(False)))
    return r.select(F.col("probe").alias("nuisance"), "n", F.col("auc").alias("survival_auc"), "label_auc", "coverage", "unmeasurable", "live",
                    F.when(F.col("live") | F.col("unmeasurable"), "warn").otherwise("ok").alias("verdict"))
