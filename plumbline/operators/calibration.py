"""Temperatures, type posterior and operating points by distributed grid search.

A grid is an array literal exploded beside each row and summed at once per grid point and class, so
only the sums are shuffled: their number is the grid times classes, whatever the number of rows.
Class weights are constant inside a class, so they enter after the sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import metrics as X
from plumbline.functions import scalar as S
from plumbline.functions.lookup import small_join
from plumbline.operators import evaluation as E
from plumbline.session import cut_lineage

# Fixed values of the search.
NO_SIGNAL = 0.245
TEMPERATURES = (0.08, 8.0, 240)
AUG_WEIGHT = 0.2


def geometric(lo: float, hi: float, n: int) -> list[float]:
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]


def linear(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def compress(rows: DataFrame, groups: Sequence[str], values: Sequence[str], digits: int) -> DataFrame:
    """Rounded values with a count ``copies``: for searches where rows times grid is too large."""
    return rows.groupBy(*groups, *[F.round(v, digits).alias(v) for v in values]).agg(F.count(F.lit(1)).alias("copies"))


def _squared(p: Column, y: str) -> Column:
    return (p - F.col(y)) * (p - F.col(y))


def temperature_sums(rows: DataFrame, groups: Sequence[str], y: str, margin: str, cls: str,
                     grid: Sequence[float]) -> DataFrame:
    """(groups, i, t, cls) -> squared error and rows at every temperature."""
    n = F.col("copies") if "copies" in rows.columns else F.lit(1)
    keep = list(dict.fromkeys([*groups, y, cls, margin]))
    g = rows.select(*keep, n.alias("_c"), F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("i", "t"))
    p = S.sigmoid(F.col(margin) / F.col("t"))
    return g.groupBy(*groups, "i", "t", cls).agg(F.sum(F.col("_c") * _squared(p, y)).alias("se"), F.sum("_c").alias("n"))


def class_weighted(sums: DataFrame, keys: Sequence[str], cls: str, targets: Mapping[object, float]) -> DataFrame:
    """Brier per key under class targets; classes that do not occur drop out."""
    t = F.lit(0.0)
    for k, v in targets.items():
        t = F.when(F.col(cls) == k, F.lit(float(v))).otherwise(t)
    return sums.groupBy(*keys).agg((F.sum(t * F.col("se") / F.col("n")) / F.sum(t)).alias("brier"))


def blend_views(briers: DataFrame, keys: Sequence[str], view: str = "view", aug_weight: float = AUG_WEIGHT) -> DataFrame:
    """Base and aug Brier mixed; base alone where there is no aug view."""
    b = briers.groupBy(*keys).agg(F.max(F.when(F.col(view) == "base", F.col("brier"))).alias("_b"),
                                  F.max(F.when(F.col(view) == "aug", F.col("brier"))).alias("_a"))
    return b.select(*keys, F.coalesce(F.col("_b") * (1 - aug_weight) + F.col("_a") * aug_weight, "_b").alias("brier"))


def pick_temperature(briers: DataFrame, groups: Sequence[str], grid_size: int) -> DataFrame:
    """Smallest Brier, the first on ties; flags a pick at the grid's edge; 1.0 where nothing is gained."""
    best = briers.groupBy(*groups).agg(F.min(F.struct("brier", "i", "t")).alias("_m"))
    no_signal = F.col("_m.brier") >= NO_SIGNAL
    return best.select(*groups, F.when(no_signal, 1.0).otherwise(F.col("_m.t")).alias("temperature"),
                       F.col("_m.brier").alias("brier"), F.col("_m.i").isin(0, grid_size - 1).alias("at_edge"),
                       no_signal.alias("no_signal"))


def fit_temperature(rows: DataFrame, groups: Sequence[str] = (), *, y: str = "y", margin: str = "margin", cls: str | None = None,
                    targets: Mapping[object, float] | None = None, grid: Sequence[float] | None = None) -> DataFrame:
    """One temperature per group from rows with a ``view`` column of base and aug."""
    grid, cls = grid or geometric(*TEMPERATURES), cls or y
    sums = temperature_sums(rows, [*groups, "view"], y, margin, cls, grid)
    b = class_weighted(sums, [*groups, "view", "i", "t"], cls, targets or E.class_targets())
    return pick_temperature(blend_views(b, [*groups, "i", "t"]), groups, len(grid))


def fit_spread_temperature(rows: DataFrame, *, y: str = "y", n_t: int = 80, n_k: int = 41, k_max: float = 2.0,
                           targets: Mapping[int, float] | None = None) -> DataFrame:
    """(T0, k) of T0 (1 + k spread), with the scalar fit, which is the k = 0 part of the same grid."""
    ts, ks = geometric(*TEMPERATURES[:2], n_t), [0.0, *geometric(1e-3, k_max, n_k - 1)]
    n = F.col("copies") if "copies" in rows.columns else F.lit(1)
    g = rows.select("view", y, "margin", "spread", n.alias("_c"), F.posexplode(F.array(*[F.lit(k) for k in ks])).alias("j", "k"))
    g = g.withColumn("_m", F.col("margin") / (F.lit(1.0) + F.col("k") * F.col("spread")))
    g = g.select("view", y, "j", "k", "_m", "_c", F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("i", "t"))
    sums = g.groupBy("view", "j", "k", "i", "t", y).agg(
        F.sum(F.col("_c") * _squared(S.sigmoid(F.col("_m") / F.col("t")), y)).alias("se"), F.sum("_c").alias("n"))
    b = blend_views(class_weighted(sums, ["view", "j", "k", "i", "t"], y, targets or E.class_targets()), ["j", "k", "i", "t"])
    best = F.min(F.struct("brier", "j", "i", "k", "t"))
    scalar = F.min(F.when(F.col("j") == 0, F.struct("brier", "i", "t")))
    m = b.agg(best.alias("m"), scalar.alias("s"))
    none = F.col("m.brier") >= NO_SIGNAL
    edge = F.col("m.i").isin(0, n_t - 1) | (F.col("m.j") == n_k - 1)
    return m.select(F.when(none, 1.0).otherwise(F.col("m.t")).alias("temperature"), F.when(none, 0.0).otherwise(F.col("m.k")).alias("slope"),
                    F.col("m.brier").alias("brier"), F.col("s.t").alias("scalar_temperature"), F.col("s.brier").alias("scalar_brier"),
                    (F.col("s.brier") - F.col("m.brier")).alias("gain"), edge.alias("at_edge"))


# ---- type posterior -----------------------------------------------------------------------------

# The grid of temperatures and biases of the type margin, the bias of a pinned posterior, the caps.
TYPE_TEMPERATURES, TYPE_BIASES, PINNED_BIAS, TYPE_CAPS = (0.25, 8.0, 60), (-6.0, 1.0, 57), -3.0, (0.2, 0.95, 16)


def fit_type_margin(rows: DataFrame, semi_prior: float, y3: str = "y3", d2: str = "d2", q_min: float = 1e-3) -> DataFrame:
    """(T2, b2) least in prior-corrected Brier of semisynthetic among fakes, on a grid."""
    ts, bs = geometric(*TYPE_TEMPERATURES), linear(*TYPE_BIASES)
    f = rows.filter(F.col(y3) > 0).select(F.when(F.col(y3) == 2, 1.0).otherwise(0.0).alias("s"), F.col(d2).alias("m"))
    g = f.select("s", "m", F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("i", "t"))
    g = g.select("s", (F.col("m") / F.col("t")).alias("m"), "i", "t", F.posexplode(F.array(*[F.lit(b) for b in bs])).alias("j", "b"))
    p = S.sigmoid(F.col("m") + F.col("b"))
    sums = g.groupBy("i", "t", "j", "b", "s").agg(F.sum((p - F.col("s")) * (p - F.col("s"))).alias("se"), F.count(F.lit(1)).alias("n"))
    b = class_weighted(sums, ["i", "t", "j", "b"], "s", {1.0: semi_prior, 0.0: 1.0 - semi_prior})
    before = semi_prior * (1.0 - q_min) ** 2 + (1.0 - semi_prior) * q_min ** 2
    both = f.agg(F.count_distinct("s")).scalar() > 1
    m = b.agg(F.min(F.struct("brier", "i", "j", "t", "b")).alias("m"))
    # With one of the two classes missing there is nothing to fit: the posterior stays pinned.
    return m.select(F.when(both, F.col("m.t")).otherwise(1.0).alias("type_temperature"), F.when(both, F.col("m.b")).otherwise(PINNED_BIAS).alias("type_bias"),
                    F.lit(before).alias("brier_before"), F.when(both, F.col("m.brier")).otherwise(before).alias("brier_after"), (~both).alias("pinned"))


def type_cap_scores(rows: DataFrame, semi_prior: float, temperature: float | Column, bias: float | Column, p_fake: str, y3: str = "y3", d2: str = "d2",
                    q_min: float = 1e-3, allow_suppression: bool = False, deploy_p_fake: float = 0.5) -> DataFrame:
    """Three-class score at every cap of the type posterior; cap = q_min is the pinned posterior. Temperature and bias are numbers
    or single values of a fit.

    Caps up to one half make the third class unreachable and are searched only on request.
    """
    caps = [q for q in linear(*TYPE_CAPS) if allow_suppression or q > 0.5 + 1e-6]
    w = E.share_weights(rows, y3, E.three_class_targets(semi_prior, deploy_p_fake))
    g = w.withColumn("q_max", F.explode(F.array(*[F.lit(q) for q in [q_min, *caps]])))
    q = S.clamp(S.sigmoid(F.col(d2) / _value(temperature) + _value(bias)), q_min, F.col("q_max"))
    g = g.withColumn("_probs", S.compose_three(F.col(p_fake), q))
    return E.three_class_scores(g, ["q_max"], y3, "_probs", "weight")


def _value(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def type_effects(rows: DataFrame, temperature: float | Column, bias: float | Column, q_max: float | Column, p_fake: str, y3: str = "y3", d2: str = "d2",
                 q_min: float = 1e-3) -> DataFrame:
    """What calibration does to each class: (stage, recall_real, recall_synthetic, recall_semisynthetic, semi_predicted) for the type
    margin as it is (raw), fitted and capped (calibrated), and held at q_min (pinned). A class without rows has no recall."""
    raw, fitted = S.sigmoid(F.col(d2)), S.clamp(S.sigmoid(F.col(d2) / _value(temperature) + _value(bias)), q_min, _value(q_max))
    stages = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), q.alias("q")) for k, q in (("raw", raw), ("calibrated", fitted), ("pinned", F.lit(q_min)))])).alias("s")
    r = rows.select(y3, p_fake, stages).select(F.col(y3).alias("y"), "s.stage", S.compose_three(F.col(p_fake), F.col("s.q")).alias("p"))
    r = r.withColumn("told", F.array_position("p", F.array_max("p")) - 1)  # the first of equal ones
    recall = [F.avg(F.when(F.col("y") == k, (F.col("told") == k).cast("double"))).alias(f"recall_{n}") for k, n in enumerate(S.KINDS)]
    return r.groupBy("stage").agg(*recall, F.count(F.when(F.col("told") == 2, 1)).alias("semi_predicted"))


def fit_type_posterior(rows: DataFrame, semi_prior: float, p_fake: str, y3: str = "y3", d2: str = "d2", q_min: float = 1e-3,
                       allow_suppression: bool = False, deploy_p_fake: float = 0.5) -> DataFrame:
    """One row: the fitted temperature and bias of the type margin, then the cap that they lead to, with scores and Briers before and after.

    Where fakes of one type only are there, nothing is fitted and the posterior stays pinned: cap q_min, scores equal.
    """
    fit = cut_lineage(fit_type_margin(rows, semi_prior, y3, d2, q_min))
    of = lambda c: fit.select(c).scalar()
    scores = type_cap_scores(rows, semi_prior, of("type_temperature"), of("type_bias"), p_fake, y3, d2, q_min, allow_suppression, deploy_p_fake)
    cap = pick_cap(scores, q_min)
    pinned = of("pinned")
    return cap.select(of("type_temperature").alias("type_temperature"), of("type_bias").alias("type_bias"), F.when(pinned, q_min).otherwise(F.col("q_max")).alias("q_max"),
                      of("brier_before").alias("brier_before"), of("brier_after").alias("brier_after"), "score_before",
                      F.when(pinned, F.col("score_before")).otherwise(F.col("score_after")).alias("score_after"), pinned.alias("pinned"))


def pick_cap(scores: DataFrame, q_min: float = 1e-3) -> DataFrame:
    """Best cap when it beats the pinned posterior, else the pinned one; the smallest cap on ties, and
    scores that differ in the tenth decimal are a tie, so that summation order decides nothing."""
    scores = scores.withColumn("score", F.round("score", 9))
    pinned = F.max(F.when(F.col("q_max") == q_min, F.col("score")))
    best = F.max(F.when(F.col("q_max") != q_min, F.struct(F.col("score"), (-F.col("q_max")).alias("nq"))))
    s = scores.agg(pinned.alias("score_before"), best.alias("_b"))
    better = F.col("_b.score") > F.col("score_before")
    return s.select(F.when(better, -F.col("_b.nq")).otherwise(F.lit(q_min)).alias("q_max"), "score_before",
                    F.when(better, F.col("_b.score")).otherwise(F.col("score_before")).alias("score_after"))


# ---- cross-fit, mixture, headroom ---------------------------------------------------------------

def crossfit_temperatures(rows: DataFrame, fold: str, y: str = "y", grid: Sequence[float] | None = None, max_ratio: float = 2.0,
                          group: str | None = None, min_groups: int = 4) -> DataFrame:
    """fold -> temperature fitted on the other folds; all folds from one pass of additive sums.

    The fit on all rows stands in for a fold whose other folds hold one class only, and for every fold when the folds
    differ by more than ``max_ratio`` or there are fewer than ``min_groups`` values of ``group``.
    """
    grid = grid or geometric(*TEMPERATURES)
    sums = cut_lineage(temperature_sums(rows, ["view", fold], y, "margin", y, grid))  # a few sums, read many times
    total = sums.groupBy("view", "i", "t", y).agg(F.sum("se").alias("se"), F.sum("n").alias("n"))
    # Sums of the other folds: the total less the fold's own, which is nothing for a class it lacks.
    ids = sums.agg(F.collect_set(fold)).scalar()
    mine = sums.select("view", "i", y, fold, F.col("se").alias("_se"), F.col("n").alias("_n"))
    others = (total.withColumn(fold, F.explode(ids)).join(mine, ["view", "i", y, fold], "left")
              .withColumn("se", F.col("se") - F.coalesce("_se", F.lit(0.0))).withColumn("n", F.col("n") - F.coalesce("_n", F.lit(0))))
    full = pick_temperature(blend_views(class_weighted(total, ["view", "i", "t"], y, E.class_targets()), ["i", "t"]), [], len(grid))
    per = pick_temperature(blend_views(class_weighted(others.filter("n > 0"), ["view", fold, "i", "t"], y, E.class_targets()),
                                       [fold, "i", "t"]), [fold], len(grid))
    one = Window.partitionBy(F.lit(1))
    whole = full.select("temperature").scalar()
    classes = others.filter("n > 0").groupBy("view", fold).agg(F.count_distinct(y).alias("_c")).groupBy(fold).agg(F.min("_c").alias("_c"))
    per = classes.join(per, fold, "left").select(fold, F.when(F.col("_c") > 1, F.col("temperature")).otherwise(whole).alias("fitted"))
    ratio = F.max("fitted").over(one) / F.min("fitted").over(one)
    few = F.lit(False) if group is None else rows.agg(F.count_distinct(F.col(group).cast("string"))).scalar() < min_groups
    return per.select(fold, ratio.alias("fold_ratio"), "fitted", whole.alias("pooled")).withColumn(
        "temperature", F.when((F.col("fold_ratio") > max_ratio) | few, F.col("pooled")).otherwise(F.col("fitted")))


#: Newton steps of a cross-fitted sigmoid, and the gradient per row at which it counts as found.
PLATT_STEPS, PLATT_GRADIENT = 10, 1e-12


def crossfit_platt(rows: DataFrame, fold: str, folds: int, y: str = "y", margin: str = "margin") -> DataFrame:
    """(fold, a, b): the sigmoid fitted on the other folds, (1, 0) where those hold one class only.

    Equal margins are counted once. A Newton step is then one aggregation for all folds together, which adds up loss, gradient and
    curvature, six numbers for each fold; a step that makes the loss larger is halved. Null margins, labels and folds are left out.
    """
    counted = cut_lineage(rows.filter(F.col(margin).isNotNull() & F.col(y).isNotNull() & F.col(fold).isNotNull()).groupBy(
        F.col(fold).cast("int").alias("f"), F.col(y).cast("double").alias("y"), F.col(margin).cast("double").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    now = {f: (1.0, 0.0) for f in range(folds)}
    kept: dict[int, tuple] = {}
    open_ = set(now)
    for _ in range(PLATT_STEPS):
        models = F.explode(F.array(*[F.struct(F.lit(f).alias("k"), F.lit(now[f][0]).alias("a"), F.lit(now[f][1]).alias("b")) for f in sorted(open_)])).alias("s")
        r = counted.select("f", "y", "m", "n", models).filter("f <> s.k").withColumn("z", F.col("s.a") * F.col("m") + F.col("s.b"))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
        n, m, d, h = F.col("n"), F.col("m"), p - F.col("y"), p * (1 - p)
        loss = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
        sums = r.groupBy("s.k").agg(*[F.sum(n * c).alias(k) for k, c in (("loss", loss), ("ga", d * m), ("gb", d), ("haa", h * m * m), ("hab", h * m), ("hbb", h))],
                                    F.sum("n").alias("n"), F.sum(n * F.col("y")).alias("ones")).collect()
        for s in sums:
            k = s["k"]
            if not 0 < s["ones"] < s["n"]:
                now[k] = (1.0, 0.0)
                open_.discard(k)
                continue
            old = kept.get(k)
            if old and s["loss"] > old[2] * (1 + 1e-12):
                now[k] = ((now[k][0] + old[0]) / 2, (now[k][1] + old[1]) / 2)
                continue
            kept[k] = (*now[k], s["loss"])
            if max(abs(s["ga"]), abs(s["gb"])) <= PLATT_GRADIENT * s["n"]:
                open_.discard(k)
                continue
            ridge = 1e-12 * (s["haa"] + s["hbb"])
            det = (s["haa"] + ridge) * (s["hbb"] + ridge) - s["hab"] ** 2
            now[k] = (now[k][0] - (s["ga"] * (s["hbb"] + ridge) - s["gb"] * s["hab"]) / det, now[k][1] - (s["gb"] * (s["haa"] + ridge) - s["ga"] * s["hab"]) / det)
        open_ &= {s["k"] for s in sums}  # a fold whose complement is empty has nothing to fit
        if not open_:
            break
    out = [(f, *(kept[f][:2] if f in kept else (1.0, 0.0))) for f in range(folds)]
    return rows.sparkSession.createDataFrame(out, f"{fold} int, a double, b double")


def apply_platt(rows: DataFrame, fits: DataFrame, fold: str, margin: str = "margin", out: str = "p_fake") -> DataFrame:
    """Every row's probability by the fit of its own fold."""
    return small_join(rows, fits, [fold], "inner").withColumn(out, 1 / (1 + F.exp(-(F.col("a") * F.col(margin) + F.col("b"))))).drop("a", "b")


def mixture_temperature(rows: DataFrame, pool: str, shares: Mapping[str, float], y: str = "y", grid: Sequence[float] | None = None) -> DataFrame:
    """One temperature for pools of fixed mass, class-balanced inside each, with each pool's Brier there."""
    grid = grid or geometric(*TEMPERATURES)
    sums = temperature_sums(rows, [pool], y, "margin", y, grid)
    b = class_weighted(sums, [pool, "i", "t"], y, E.class_targets())
    s = F.lit(0.0)
    for k, v in shares.items():
        s = F.when(F.col(pool) == k, F.lit(float(v))).otherwise(s)
    mix = b.groupBy("i", "t").agg((F.sum(s * F.col("brier")) / F.sum(s)).alias("brier"), F.map_from_entries(
        F.collect_list(F.struct(pool, "brier"))).alias("pool_brier"))
    best = mix.agg(F.min_by(F.struct("t", "brier", "pool_brier"), F.struct("brier", "i")).alias("m"))
    return best.select(F.col("m.t").alias("temperature"), F.col("m.brier").alias("brier"),
                       *[F.col("m.pool_brier").getItem(k).alias(f"brier_{k}") for k in shares])


def anchored_sweep(rows: DataFrame, pool: str, local: str, hidden: str, *, observed_mcc: float, observed_brier: float,
                   current: float, hidden_weight: float = 0.3, y: str = "y") -> DataFrame:
    """Predicted gain of a new temperature, anchored so that the current one reproduces the observed
    Brier; a gain inside half the anchor residual is noise."""
    grid = geometric(0.2, 6.0, 121)
    near = min(range(len(grid)), key=lambda i: abs(grid[i] - current))
    sums = temperature_sums(rows, [pool], y, "margin", y, [*grid, current])
    b = class_weighted(sums, [pool, "i", "t"], y, E.class_targets())
    s = F.when(F.col(pool) == local, 1.0 - hidden_weight).when(F.col(pool) == hidden, hidden_weight).otherwise(0.0)
    mix = b.groupBy("i", "t").agg(F.sum(s * F.col("brier")).alias("brier"))
    on = F.col("i") < len(grid)
    m = mix.agg(F.min(F.when(on, F.struct("brier", "i", "t"))).alias("best"), F.max(F.when(F.col("i") == near, F.col("brier"))).alias("_near"),
                F.max(F.when(~on, F.col("brier"))).alias("_cur"))
    anchor = F.lit(observed_brier) - F.col("_cur")
    at_best = F.col("best.brier") + anchor
    gain, bar = F.col("_near") - F.col("best.brier"), F.abs(anchor) / 2.0
    now = X.quality_score(F.lit(observed_mcc), F.lit(observed_brier))
    then = X.quality_score(F.lit(observed_mcc), F.greatest(at_best, F.lit(0.0)))
    return m.select(F.col("best.t").alias("temperature"), anchor.alias("anchor"), at_best.alias("predicted_brier"), gain.alias("brier_gain"),
                    (then - now).alias("score_gain"), bar.alias("noise"), (gain > F.greatest(bar, F.lit(0.002))).alias("confident"))


def fit_platt(rows: DataFrame, y: str = "y", margin: str = "margin", weight: str | None = None) -> tuple[float, float]:
    """(a, b) of sigmoid(a margin + b): unregularised logistic regression on one feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=[margin], outputCol="_x").transform(rows)
    lr = LogisticRegression(featuresCol="_x", labelCol=y, regParam=0.0, standardization=False, maxIter=100, tol=1e-9)
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(data)
    return float(model.coefficients[0]), float(model.intercept)


# ---- operating point ----------------------------------------------------------------------------

# Fixed values of the sweep.
P_MIN = (1e-6, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12)
P_MAX = (1.0 - 1e-6, 0.99, 0.98, 0.97, 0.95, 0.92)
T_MULT = tuple(sorted({1.0, *geometric(0.7, 2.5, 21)}))


def operating_points(rows: DataFrame, scenario: str = "scenario", y: str = "y", p: str = "p_fake", weight: str = "weight") -> DataFrame:
    """Blended score of every (t, p_min, p_max) per scenario; rows carry a ``view`` of base and aug.

    Clamping only matters by which side of the limits a probability falls, so rows are summed once
    per temperature into the intervals between limits, and the limits are applied to those sums.
    """
    edges = sorted({*P_MIN, *P_MAX})
    g = rows.select(scenario, "view", y, weight, S.logit(F.col(p)).alias("_l"), F.posexplode(F.array(*[F.lit(t) for t in T_MULT])).alias("i", "t"))
    q = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_l") / F.col("t")))
    g = g.withColumn("_q", q)
    at = F.lit(0)
    for e in edges:
        at = at + F.when(F.col("_q") > e, 1).otherwise(0)
    yes, hit, w = F.col(y) == 1, F.col("_q") > 0.5, F.col(weight)
    cells = g.groupBy(scenario, "view", "i", "t", at.alias("at"), y).agg(
        F.sum(w).alias("w"), F.sum(w * _squared(F.col("_q"), y)).alias("se"), F.sum(F.when(hit, w).otherwise(0.0)).alias("up"))
    pairs = F.explode(F.array(*[F.struct(F.lit(lo).alias("p_min"), F.lit(edges.index(lo)).alias("a"), F.lit(hi).alias("p_max"), F.lit(edges.index(hi)).alias("b"))
                                for lo in P_MIN for hi in P_MAX])).alias("s")
    c = cells.select("*", pairs)
    low, high = F.col("at") <= F.col("s.a"), F.col("at") > F.col("s.b")
    se = F.when(low, F.col("w") * _squared(F.col("s.p_min"), y)).when(high, F.col("w") * _squared(F.col("s.p_max"), y)).otherwise(F.col("se"))
    zero = F.lit(0.0)
    m = c.groupBy(scenario, "view", "i", "t", "s.p_min", "s.p_max").agg(
        F.sum(F.when(yes, F.col("up")).otherwise(zero)).alias("tp"), F.sum(F.when(~yes, F.col("up")).otherwise(zero)).alias("fp"),
        F.sum(F.when(yes, F.col("w") - F.col("up")).otherwise(zero)).alias("fn"), F.sum(F.when(~yes, F.col("w") - F.col("up")).otherwise(zero)).alias("tn"),
        F.sum(se).alias("_se"), F.sum("w").alias("_w"))
    mcc = X.mcc(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    s = m.select(scenario, "view", "t", "p_min", "p_max", mcc.alias("mcc"), X.quality_score(mcc, F.col("_se") / F.col("_w")).alias("score"))
    return E.blended(s, [scenario, "t", "p_min", "p_max"], "view").drop("base", "aug")


def recommend(points: DataFrame, clean: str, scenario: str = "scenario", max_cost: float = 0.002) -> DataFrame:
    """The setting with the best worst-case gain over scenarios, among those that cost the clean
    scenario at most ``max_cost``. Gains are against t = 1 without limits."""
    ident = (F.col("t") == 1.0) & (F.col("p_min") == P_MIN[0]) & (F.col("p_max") == P_MAX[0])
    base = F.max(F.when(ident, F.col("blended"))).over(Window.partitionBy(scenario))
    g = points.withColumn("gain", F.round(F.col("blended") - base, 12))
    per = g.groupBy("t", "p_min", "p_max").agg(F.min("gain").alias("min_gain"), F.max(F.when(F.col(scenario) == clean, F.col("gain"))).alias("clean_gain"))
    ok = per.filter(F.col("clean_gain") >= -max_cost)
    return ok.orderBy(F.desc("min_gain"), "t", "p_min", F.desc("p_max")).limit(1)


def _beta_quantiles(a: float, b: float, low: float, high: float, n: int = 200) -> list[float]:
    """Quantiles of a Beta distribution at n + 1 even steps, by summing its density."""
    steps = 20_000
    mass, total = [], 0.0
    for i in range(steps):
        x = (i + 0.5) / steps
        total += x ** (a - 1) * (1 - x) ** (b - 1)
        mass.append(total)
    out, i = [], 0
    for k in range(n + 1):
        while i < steps - 1 and mass[i] < total * k / n:
            i += 1
        out.append(min(max((i + 0.5) / steps, low), high))
    return out


# Shape of the scores of confidently wrong fakes; names of simulated held-out rows, real and fake.
INVERTED_SHAPE = _beta_quantiles(1.2, 20.0, 1e-4, 0.499)
HELD_OUT = ("real-image-holdout-simr", "synthetic-image-holdout-simf")


def scenario_pool(base: DataFrame, inverted_share: float, seed: int, n_fake: int, n_real: int, inverted: DataFrame) -> DataFrame:
    """A simulated hidden class: most draws repeat the model's own scores of the label, a share comes
    from ``inverted(p_fake)``, scores of confidently wrong fakes, or without any from the shape of such scores,
    Beta(1.2, 20) within [1e-4, 0.499]. The rows' names mark them as held out. All draws are equality joins on a
    row number, so any row may be drawn any number of times without a collected pool."""
    from plumbline.functions import ranking as R
    spark = base.sparkSession

    def numbered(df: DataFrame, key: str, tag: str) -> DataFrame:
        r = df.withColumn("_u", S.stable_fraction(F.col(key), f"{seed}|{tag}"))
        return R.hash_rank(r, [], "_u", key, "_rk").select((F.col("_rk") - 1).alias("at"), "p_fake")

    out = None
    for y, n in ((1, n_fake), (0, n_real)):
        wrong = round(n * inverted_share)
        own = base.filter(F.col("y") == y)
        for pool, lo, hi, flip in ((inverted, 0, wrong, y == 0), (own, wrong, n, False)):
            if hi <= lo:
                continue
            slot = spark.range(lo, hi).withColumnRenamed("id", "slot")
            if pool is inverted and pool.isEmpty():
                u = S.stable_fraction(F.col("slot"), f"{seed}|{y}|shape") * (len(INVERTED_SHAPE) - 1)
                at = F.floor(u).cast("int")
                shape = F.array(*[F.lit(x) for x in INVERTED_SHAPE])
                low, high = F.get(shape, at), F.coalesce(F.get(shape, at + 1), F.get(shape, at))
                p = low + (high - low) * (u - at)
                d = slot.select("slot", ((F.lit(1.0) - p) if flip else p).alias("p_fake"), F.lit(y).alias("y"))
                out = d if out is None else out.unionByName(d)
                continue
            total = pool.agg(F.count(F.lit(1))).scalar()
            slot = slot.withColumn("at", S.stable_choice(F.col("slot"), f"{seed}|{y}|{lo}", total))
            d = slot.join(numbered(pool, "vec_id", f"{y}|{lo}"), "at")
            p = (F.lit(1.0) - F.col("p_fake")) if flip else F.col("p_fake")
            d = d.select("slot", p.alias("p_fake"), F.lit(y).alias("y"))
            out = d if out is None else out.unionByName(d)
    return out.withColumn("dataset", F.when(F.col("y") == 1, HELD_OUT[1]).otherwise(HELD_OUT[0]))


def parity(scores: DataFrame, recorded: DataFrame, keys: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """Own score against the recorded one; more than ``tolerance`` apart fails."""
    drift = F.abs(F.col("score") - F.col("recorded"))
    return scores.join(recorded, list(keys)).withColumn("drift", drift).withColumn("failed", drift > tolerance)


def select_checkpoint(scores: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted mean score per checkpoint over the splits it was scored on, best first."""
    w = F.lit(0.0)
    for k, v in weights.items():
        w = F.when(F.col("split") == k, F.lit(float(v))).otherwise(w)
    s = scores.groupBy("checkpoint").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("selection"))
    first = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("selection", 9)), "checkpoint"))
    return s.withColumn("best", first == 1)
