"""Registry rules, the manifest build and its coverage and distribution reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S
from plumbline.functions.lookup import small_join


# ---- registry rules -----------------------------------------------------------------------------

def duplicate_names(registry: DataFrame, name: str = "name") -> DataFrame:
    return registry.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def add_missing(registry: DataFrame, extra: DataFrame, key: str = "name") -> DataFrame:
    """Registry plus local entries whose name it does not hold; the registry entry wins."""
    return registry.unionByName(extra.join(registry, key, "left_anti"), allowMissingColumns=True)


def unknown_names(rules: DataFrame, registry: DataFrame, key: str = "name") -> DataFrame:
    """Rule names the registry does not know."""
    return rules.select(key).distinct().join(registry, key, "left_anti")


def fix_categories(registry: DataFrame, fixes: DataFrame) -> DataFrame:
    """``fixes(name, fix)`` over the registry's own category, over 'unknown'."""
    own = F.when(F.col("content_category") != "", F.col("content_category"))
    return registry.join(fixes, "name", "left").withColumn(
        "content_category_fixed", F.coalesce("fix", own, F.lit("unknown"))).drop("fix")


def resolve_kinds(registry: DataFrame, listed: DataFrame) -> DataFrame:
    """Registry truth for real; ``listed(name)`` promotes the rest to semisynthetic."""
    mt = F.trim(F.col("media_type"))
    own = F.when(mt == "semisynthetic", "semisynthetic").otherwise("synthetic")
    mark = listed.select("name").distinct().withColumn("_listed", F.lit(True))
    return (registry.join(mark, "name", "left")
            .withColumn("kind", F.when(mt == "real", "real").when(F.col("_listed"), "semisynthetic").otherwise(own))
            .withColumn("promoted", (F.col("kind") == "semisynthetic") & (mt != "semisynthetic"))
            .drop("_listed"))


def release_groups(registry: DataFrame, shards: DataFrame) -> DataFrame:
    """Every shard of a release -> the first shard the registry holds; others -> themselves.

    ``shards(shard_id, pos, name)``.
    """
    def in_order(c: str) -> Column:
        """By the number that the value ends in, so that 10 follows 9."""
        return F.struct(F.regexp_extract(F.col(c).cast("string"), "([0-9]*)$", 1).try_cast("bigint"), F.col(c))
    present = shards.join(registry.select("name"), "name", "left_semi")
    first = present.groupBy("shard_id").agg(F.min_by("name", in_order("pos")).alias("release"))
    owner = present.join(first, "shard_id").groupBy("name").agg(F.max_by("release", in_order("shard_id")).alias("release"))
    return registry.join(owner, "name", "left").withColumn(
        "group", F.coalesce("release", "name")).drop("release")


def folded_categories(rows: DataFrame, category: str, label: str) -> DataFrame:
    """category -> category to balance on; one that carries a single label -> the catch-all."""
    seen = rows.groupBy(category).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    return seen.select(category, F.when(F.col("_lo") == F.col("_hi"), S.FOLD_TARGET)
                       .otherwise(F.col(category)).alias("folded"))


def fold_categories(rows: DataFrame, category: str, label: str, out: str) -> DataFrame:
    return small_join(rows, folded_categories(rows, category, label), [category], "inner").withColumnRenamed("folded", out)


# ---- manifest build -----------------------------------------------------------------------------

def build(metadata: DataFrame, registry: DataFrame, files: DataFrame, *, fixes: DataFrame,
          listed: DataFrame, shards: DataFrame, extra: DataFrame | None = None,
          target_side: int = 512) -> DataFrame:
    """The manifest as one lazy plan.

    ``metadata(dataset, iso_week, file, path, source_file)`` lists what should exist,
    ``files(path, width, height, file_format, pil_mode, file_bytes)`` what could be read.
    Datasets unknown to the registry and files that could not be read drop out.
    """
    entries = add_missing(registry, extra) if extra is not None else registry
    dims = resolve_kinds(release_groups(fix_categories(entries, fixes), shards), listed)
    dims = fold_categories(dims.withColumn("label", S.media_label(F.col("media_type"))),
                           "content_category_fixed", "label", "category")
    dims = dims.withColumnRenamed("name", "dataset").withColumnRenamed("path", "source_path").drop("promoted")
    rows = metadata.join(dims, "dataset").join(files, "path")
    geo = S.geometry(F.col("width"), F.col("height"), F.col("file_bytes"), target_side)
    rows = rows.select("*", *[c.alias(k) for k, c in geo.items()])
    return rows.select(
        S.row_id(F.col("dataset"), F.col("iso_week"), F.col("file")).alias("image_id"),
        "path", "dataset", "label", "media_type", "kind",
        F.coalesce("generator_family", F.lit("unknown")).alias("generator_family"),
        F.coalesce("generator_variant", F.lit("")).alias("generator_variant"),
        "content_category", "content_category_fixed", "category", "group", "source_path",
        S.source_format(F.col("source_format")).alias("source_format"),
        F.coalesce("source_file", F.lit("")).alias("source_file"), "iso_week",
        S.file_index(F.col("file")).alias("file_index"),
        S.extension(F.regexp_extract("file", r"(\.[^./]*)$", 1)).alias("ext"),
        "width", "height", "file_format", "pil_mode", "file_bytes", *geo,
        F.lit("").alias("split"))


def coverage(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Names on one side only: (name, status)."""
    known, disk = registry.select("name").distinct(), found.select("name").distinct()
    return (disk.join(known, "name", "left_anti").withColumn("status", F.lit("unknown"))
            .unionByName(known.join(disk, "name", "left_anti").withColumn("status", F.lit("missing"))))


def holdout_coverage(holdouts: DataFrame, on_disk: DataFrame, in_manifest: DataFrame) -> DataFrame:
    """Required names that are absent, and from where. ``holdouts(split, name)``."""
    h = (holdouts.join(on_disk.select("name").distinct().withColumn("_d", F.lit(1)), "name", "left")
         .join(in_manifest.select("name").distinct().withColumn("_m", F.lit(1)), "name", "left"))
    where = F.concat_ws("/", F.when(F.col("_d").isNull(), "disk"), F.when(F.col("_m").isNull(), "manifest"))
    return h.select("split", "name", where.alias("missing_where")).filter("missing_where <> ''")


def missing_mates(holdouts: DataFrame, cliques: DataFrame, in_manifest: DataFrame) -> DataFrame:
    """Present holdout names whose clique partners are not. ``cliques(clique_id, name)``."""
    there = in_manifest.select("name").distinct()
    held = holdouts.join(there, "name", "left_semi").select("split", "name")
    mine = cliques.select("clique_id", "name")
    gone = cliques.select("clique_id", F.col("name").alias("mate")).join(
        there.withColumnRenamed("name", "mate"), "mate", "left_anti")
    return (held.join(mine, "name").join(gone, "clique_id")
            .filter(F.col("mate") != F.col("name")).select("split", "name", "mate").distinct())


def names_from_spec(specs: DataFrame) -> DataFrame:
    """``(split, spec map<side, array<name>>)`` -> (split, side, name)."""
    return (specs.select("split", F.explode("spec").alias("side", "names"))
            .select("split", "side", F.explode("names").alias("name")))


# Splits that a closed gate may park its names in, the first where it names none.
PARKS = ("val_xgen", "val_stress", "test")


def parked_names(gates: DataFrame) -> DataFrame:
    """(split, side, name) of every closed gate. ``gates(gate, include, dest, side, name)``; a gate that isn't said to be
    included is closed, one without a destination parks in val_xgen, and any other destination than PARKS is an error."""
    dest = F.coalesce("dest", F.lit(PARKS[0]))
    wrong = F.raise_error(F.concat(F.lit("gate "), F.coalesce("gate", F.lit("")), F.lit(" parks in "), dest)).cast("string")
    closed = gates.filter(~F.coalesce("include", F.lit(False)))
    return closed.select(F.when(dest.isin(*PARKS), dest).otherwise(wrong).alias("split"), "side", "name")


def gated_holdouts(holdouts: DataFrame, gates: DataFrame) -> DataFrame:
    """Holdouts plus the names of every closed gate."""
    return holdouts.select("split", "side", "name").unionByName(parked_names(gates)).distinct()


def origin_overlap(probes: DataFrame, train: DataFrame) -> DataFrame:
    """Training sets whose source is the same page as, above or below a probe's.

    ``probes(type, name, source_url)``, ``train(type, name, source_url)``. A prefix test becomes an
    equality: every URL is matched on itself and on each of its parent paths, so no pair is formed
    that does not overlap.
    """
    p = probes.select("type", S.normal_url(F.col("source_url")).alias("probe_url")).filter("probe_url <> ''").distinct()
    t = train.select("type", "name", S.normal_url(F.col("source_url")).alias("train_url")).filter("train_url <> ''")
    down = _parents(p, "probe_url").select("type", F.col("at").alias("train_url")).distinct()
    up = p.select("type", F.col("probe_url").alias("at"))
    below = t.join(down, ["type", "train_url"], "left_semi")
    above = (_parents(t, "train_url").join(up, ["type", "at"], "left_semi")
             .select("type", "name", "train_url"))
    return below.unionByName(above).distinct()


def _parents(df: DataFrame, url: str) -> DataFrame:
    """Each URL with itself and every parent path as ``at``."""
    parts = F.split(F.col(url), "/")
    ats = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return df.select("*", F.explode(ats).alias("at"))


# ---- reports ------------------------------------------------------------------------------------

def category_label_pivot(m: DataFrame) -> DataFrame:
    """Rows and datasets per category and label, P(fake), single-label flag."""
    by_ds = m.groupBy("category", "dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    real, fake = F.col("label") == 0, F.col("label") == 1
    return (by_ds.groupBy("category").agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("real_rows"),
        F.sum(F.when(fake, F.col("n")).otherwise(0)).alias("fake_rows"),
        F.count(F.when(real, 1)).alias("real_datasets"),
        F.count(F.when(fake, 1)).alias("fake_datasets"))
        .withColumn("p_fake", F.col("fake_rows") / (F.col("real_rows") + F.col("fake_rows")))
        .withColumn("single_label", (F.col("real_rows") == 0) | (F.col("fake_rows") == 0)))


def shares(m: DataFrame, column: str, by: str | None = "label") -> DataFrame:
    """Share of each value inside ``by``, or of the whole table when ``by`` is None."""
    keys = [by, column] if by else [column]
    c = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = c.groupBy(by).agg(F.sum("n").alias("_t"))
        return c.join(totals, by).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    return c.withColumn("share", F.col("n") / c.agg(F.sum("n")).scalar())


def share_gaps(m: DataFrame, columns: Sequence[str], over: float = 0.30) -> DataFrame:
    """Values whose share differs between the labels by more than ``over``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("s")
    c = m.select("label", pairs).groupBy("s.feature", "s.value").agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("r"), F.count(F.when(F.col("label") == 1, 1)).alias("f"))
    t = c.groupBy("feature").agg(F.sum("r").alias("rt"), F.sum("f").alias("ft")).filter("rt > 0 and ft > 0")
    return (c.join(t, "feature")
            .select("feature", "value", (F.col("r") / F.col("rt")).alias("real_share"),
                    (F.col("f") / F.col("ft")).alias("fake_share"))
            .withColumn("gap", F.abs(F.col("real_share") - F.col("fake_share"))).filter(F.col("gap") > over))


def side_quantiles(m: DataFrame, column: str, groups: Sequence[str] = ("label",)) -> DataFrame:
    """p05 p25 p50 p75 p95 and mean per group."""
    q = R.exact_quantiles(m, groups, column, {"p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95})
    mean = m.groupBy(*groups).agg(F.avg(column).alias("mean"),
                                  F.avg((F.col("m_eval") > 1).cast("double")).alias("upsampled"))
    return q.join(mean, list(groups))


def resample_bins(m: DataFrame, bins: int = 12, need: int = 50) -> DataFrame:
    """Log-spaced bins of m_eval between its 1% and 99% quantiles, clipped, counted by label."""
    ends = R.exact_quantiles(m.select("m_eval"), [], "m_eval", {"lo": .01, "hi": .99})
    m = m.select("m_eval", "label").withColumn("_e", ends.select(F.struct("lo", "hi")).scalar())
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    place = F.floor(F.lit(bins) * F.log(F.col("m_eval") / lo) / F.log(hi / lo))
    b = F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    c = (m.filter((lo > 0) & (hi > lo)).select(b.alias("bin"), "label").groupBy("bin").agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("real"),
        F.count(F.when(F.col("label") == 1, 1)).alias("fake")))
    c = c.withColumn("both", (F.col("real") >= need) & (F.col("fake") >= need))
    total = c.agg(F.sum(F.col("real") + F.col("fake"))).scalar()
    return c.withColumn("mass", (F.col("real") + F.col("fake")) / total)


def dataset_size_range(m: DataFrame) -> DataFrame:
    """Fewest, median and most rows per dataset."""
    c = m.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    med = R.exact_quantiles(c, [], "rows", {"median_rows": .5})
    return c.agg(F.min("rows").alias("min_rows"), F.max("rows").alias("max_rows")).withColumn(
        "median_rows", med.select("median_rows").scalar())


def count_floors(m: DataFrame, expected: int, tolerance: float, special: dict[str, int]) -> DataFrame:
    """Datasets below bround(expected * (1 - tolerance)); ``special`` sets another expectation by name."""
    want = F.lit(expected)
    for name, n in special.items():
        want = F.when(F.col("dataset") == name, n).otherwise(want)
    c = m.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    floor = F.bround(want * F.lit(1.0 - tolerance), 0).cast("bigint")
    return c.withColumn("floor", floor).filter("rows < floor")


def extreme_medians(m: DataFrame, high: float = 2.0, low: float = 0.25, show: int = 12) -> DataFrame:
    """The datasets whose median m_eval is furthest from 1, both ends, worst first."""
    q = R.exact_quantiles(m, ["dataset"], "m_eval", {"median_m": .5})
    return (q.filter((F.col("median_m") > high) | (F.col("median_m") < low))
            .orderBy(F.desc(F.round(F.abs(F.log("median_m")), 9)), "dataset").limit(show))


def label_quartiles(m: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles of every column on either side of the label, all columns in one pass."""
    long = m.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s"))
    return R.exact_quantiles(long.select("label", "s.feature", "s.v"), ["label", "feature"], "v", {"q25": .25, "q50": .5, "q75": .75})


def distinct_counts(m: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return m.groupBy(*by).agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])


def readable(rows: DataFrame, probed: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(rows that could be read, rows that could not)."""
    return rows.join(probed.select(key), key, "left_semi"), rows.join(probed.select(key), key, "left_anti")


def metadata_features(m: DataFrame, numeric: Sequence[str], categorical: Sequence[str], top_k: int = 12) -> DataFrame:
    """Row id, log1p of each number, and an array of one-hot names for the top values of each category.

    The vocabulary is at most ``top_k`` values per column, so it travels as one array.
    """
    vocab = R.top_values(m, categorical, top_k)
    names = vocab.agg(F.array_sort(F.collect_list(F.concat_ws("=", "feature", "value")))).scalar()
    mine = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in categorical])
    hot = F.sort_array(F.array_intersect(mine, names))
    return m.select("image_id", *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(f"log1p_{c}")
                                  for c in numeric], hot.alias("hot"))
