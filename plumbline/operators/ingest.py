"""Taking in external items: deduplication, numbering, validation, isolation, leak scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ranking as R
from plumbline.functions import scalar as S

# Name prefix of each role.
ROLE_PREFIX = {"probe": "probe-", "train": "local-"}
LABELS = ("real", "fake", "semisynthetic")


def first_copies(items: DataFrame, content: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The first item of each content. Only (hash, order) is shuffled, combined before the shuffle,
    so a content copied any number of times costs one row per input partition."""
    first = (items.select(*by, F.sha1(F.col(content)).alias("content_hash"), F.col(order))
             .groupBy(*by, "content_hash").agg(F.min(order).alias(order)))
    return first


def ingest(items: DataFrame, *, content: str, size: str, order: str, min_side: int,
           by: Sequence[str] = (), max_n: int | None = None, stem: str = "img_", digits: int = 6, keep_content: bool = False) -> DataFrame:
    """Size filter, first copy of each content, contiguous names, optional cap per ``by``.

    ``order`` must be unique; it decides which copy stays and the numbering. The content itself stays behind unless
    ``keep_content`` asks for it, to be written as it came.
    """
    big = items.filter(F.col(size) >= min_side)
    numbered = R.ordered_position(first_copies(big, content, order, by), by, order)
    if max_n is not None:
        numbered = numbered.filter(F.col("position") < max_n)
    name = F.concat(F.lit(stem), S.padded(F.col("position"), digits))
    keep = numbered.select(order, "content_hash", name.alias("fname"))
    return (items if keep_content else items.drop(content)).join(keep, order)


def ingest_counts(items: DataFrame, *, content: str, size: str, order: str, min_side: int, by: str) -> DataFrame:
    """Kept, too small and repeated items per ``by``."""
    small = F.col(size) < min_side
    first = (items.filter(~small).groupBy(F.sha1(F.col(content)).alias("h"))
             .agg(F.min_by(by, order).alias(by)))
    kept = first.groupBy(by).agg(F.count(F.lit(1)).alias("kept"))
    all_ = items.groupBy(by).agg(F.count(F.when(small, 1)).alias("too_small"), F.count(F.when(~small, 1)).alias("_big"))
    return (all_.join(kept, by, "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("bigint")))
            .withColumn("repeated", F.col("_big") - F.col("kept")).drop("_big"))


def staging_plan(staged: DataFrame, key: str, target: int, enough: int = 500) -> DataFrame:
    """Sets that still need items: fewer than 90% of the target and fewer than ``enough``."""
    have = staged.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    done = (F.col("have") >= 0.9 * target) | (F.col("have") >= enough)
    return have.filter(~done).withColumn("missing", (F.lit(target) - F.col("have")).cast("bigint"))


def pseudo_shard(name: Column, position: Column, rows: int, word: str) -> Column:
    return F.concat(name, F.lit(f"#{word}"), F.floor(position / rows).cast("bigint").cast("string"))


def isolation_violations(probes: DataFrame, train: DataFrame, key: str = "name") -> DataFrame:
    """Names that are both probe and training data."""
    return probes.select(key).distinct().join(train.select(key).distinct(), key, "left_semi")


def validate_candidates(c: DataFrame) -> DataFrame:
    """One row per broken rule: role, name prefix, label, provenance of reals, date, late date."""
    role, label, url, when = (F.col(x) for x in ("role", "label", "source_url", "collected_before"))
    known = role.isin(*ROLE_PREFIX)
    prefix = F.lit(False)
    for r, p in ROLE_PREFIX.items():
        prefix = prefix | ((role == r) & ~F.startswith(F.col("name"), F.lit(p)))
    bare = url.isNull() | when.isNull()
    month = F.try_to_timestamp(when, F.lit("yyyy-MM"))
    real = label == "real"
    rules = [
        ("error", "role", ~known),
        ("error", "prefix", prefix),
        ("error", "label", ~label.isin(*LABELS)),
        ("error", "provenance", real & bare),
        ("error", "date", real & ~bare & month.isNull()),
        ("warn", "recent", real & ~bare & (month >= F.lit("2022-01-01").cast("timestamp"))),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("reason")))
                                      for s, r, cond in rules]))
    return c.withColumn("_f", F.explode(found)).select(*c.columns, "_f.severity", "_f.reason")


def leak_scan(meta: DataFrame, listing: DataFrame, pattern: str, model: str = "model_name") -> DataFrame:
    """Rows whose generator matches, marked live when their file is still listed, gone when not."""
    hit = meta.filter(F.coalesce(F.col(model), F.lit("<missing>")).rlike(f"(?i){pattern}"))
    there = listing.select("path").distinct().withColumn("_there", F.lit(True))
    return hit.join(there, "path", "left").withColumn(
        "status", F.when(F.col("_there"), "live").otherwise("gone")).drop("_there")


def generator_census(meta: DataFrame, week: Column, model: str = "model_name") -> DataFrame:
    """Items per ISO week and generator, the most common first inside a week."""
    c = meta.groupBy(week.alias("week"), F.coalesce(F.col(model), F.lit("<missing>")).alias("model_name")).agg(
        F.count(F.lit(1)).alias("n"))
    return c.orderBy("week", F.desc("n"), "model_name")


def screen(scores: DataFrame, p: str, key: str, show: int = 20) -> DataFrame:
    """The highest-scoring items, each beside the share of the whole set above 0.5."""
    share = scores.agg(F.avg((F.col(p) > 0.5).cast("double"))).scalar()
    return scores.orderBy(F.desc(p), key).limit(show).withColumn("share_fake", share)
