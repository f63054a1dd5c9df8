"""Column expressions: identity, normalisation, geometry, margins and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FOLD_TARGET = "diverse"
KINDS = ("real", "synthetic", "semisynthetic")
PROB_EPS = 1e-7
HOLDOUT_MARKER = "-holdout-"


def padded(n: Column, digits: int) -> Column:
    """A number with leading zeros to at least so many digits; longer numbers stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(digits)), F.lit("0"))


def stable_fraction(key: Column, seed: int | str) -> Column:
    """Uniform [0, 1) from the first 52 bits of md5(key|seed); same value on every run and layout."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def stable_choice(key: Column, seed: int | str, n: Column | int) -> Column:
    """Uniform integer in [0, n) for a key."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(stable_fraction(key, seed) * n).cast("bigint")


def media_label(media_type: Column) -> Column:
    return F.when(F.lower(F.trim(media_type)) == "real", 0).otherwise(1)


def source_format(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isNull() | (v == ""), "unknown").when(v == "jpg", "jpeg").otherwise(v)


def extension(suffix: Column) -> Column:
    e = F.regexp_replace(F.lower(suffix), r"^\.+", "")
    return F.when(e == "jpeg", "jpg").otherwise(e)


def file_stem(path: Column) -> Column:
    """Last path part without its final suffix; a leading dot is part of the name."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def file_index(path: Column) -> Column:
    """The digits after the last underscore of the stem, or -1."""
    tail = F.regexp_extract(file_stem(path), r"_([0-9]+)$", 1)
    return F.coalesce(tail.try_cast("bigint"), F.lit(-1).cast("bigint"))


def row_id(dataset: Column, iso_week: Column, file: Column) -> Column:
    return F.when(iso_week == "", F.concat_ws("/", dataset, file)).otherwise(
        F.concat_ws("/", dataset, iso_week, file))


def geometry(width: Column, height: Column, file_bytes: Column, target_side: int) -> dict[str, Column]:
    short, long = F.least(width, height), F.greatest(width, height)
    return {
        "min_side": short,
        "max_side": long,
        "aspect": long / short,
        "megapixels": width * height / F.lit(1e6),
        "bytes_per_pixel": file_bytes / (width * height),
        "m_eval": F.lit(float(target_side)) / short,
    }


def three_class(label: Column, kind: Column) -> Column:
    return F.when(label == 0, 0).when(kind == "semisynthetic", 2).otherwise(1)


def provenance(name: Column, stream_marker: str, ignore_case: bool = True) -> Column:
    """holdout beats stream, anything else is public. ``stream_marker`` names the weekly feed."""
    n = F.lower(name) if ignore_case else name
    return (F.when(n.contains(HOLDOUT_MARKER), "holdout")
            .when(n.contains(stream_marker), "stream").otherwise("public"))


def normal_url(url: Column) -> Column:
    u = F.rtrim(F.lower(F.coalesce(url, F.lit(""))), F.lit("/"))
    return F.regexp_replace(u, r"^.*?://", "")


def same_origin(a: Column, b: Column) -> Column:
    """Equal, or one is a path prefix of the other. Both sides already normalised and not empty."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def reroot(path: Column, root: str, part: str = "datasets") -> Column:
    """Move everything from the last ``part`` folder on below ``root``; other paths stay."""
    return F.regexp_replace(path, rf"^(?:.*/)?({part}(?:/.*)?)$", root.rstrip("/") + "/$1")


def epoch_row_seed(row_index: Column, seed: int, epoch: Column | int) -> Column:
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    total = F.lit(seed).cast("bigint") * 1_000_003 + epoch.cast("bigint") * 9_176 + row_index.cast("bigint")
    return F.pmod(total, F.lit(2**31 - 1).cast("bigint"))


# ---- margins and probabilities ------------------------------------------------------------------

def sigmoid(x: Column) -> Column:
    """Logistic, bent at +-60 so that exp never overflows."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(60.0)), F.lit(-60.0))))


def logit(p: Column, eps: float = PROB_EPS) -> Column:
    c = clamp(p, eps, 1.0 - eps)
    return F.log(c / (F.lit(1.0) - c))


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.least(F.greatest(x, lo), hi)


def binary_margin(z: Column) -> Column:
    """logsumexp of all but the first logit, less the first."""
    rest = F.slice(z, F.lit(2), F.size(z) - 1)
    top = F.array_max(rest)
    total = F.aggregate(rest, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return top + F.log(total) - F.element_at(z, 1)


def type_margin(z: Column) -> Column:
    return F.element_at(z, 3) - F.element_at(z, 2)


def fused_margin(d: Column, weights: Sequence[float]) -> Column:
    """Weighted mean of branch margins; weights are renormalised over the branches given."""
    w = _shares(weights)
    return _fold_sum([F.element_at(d, i + 1) * F.lit(v) for i, v in enumerate(w)])


def margin_spread(d: Column, weights: Sequence[float], mean: Column) -> Column:
    """Weighted standard deviation of branch margins about their fused ``mean``."""
    w = _shares(weights)
    return F.sqrt(_fold_sum([F.pow(F.element_at(d, i + 1) - mean, F.lit(2.0)) * F.lit(v) for i, v in enumerate(w)]))


def _shares(weights: Sequence[float]) -> list[float]:
    total = float(sum(weights))
    return [w / total for w in weights]


def _fold_sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def hinge_probability(margin: Column, spread: Column, temperature: float, slope: float = 0.0,
                      pivot: float = 0.0, p_min: float = 1e-6, p_max: float = 1.0 - 1e-6) -> Column:
    """sigmoid(margin / (T0 (1 + k max(0, spread - pivot)))) held inside [p_min, p_max]."""
    if not 0.0 < p_min < 0.5 < p_max < 1.0:
        raise ValueError(f"need 0 < p_min < 0.5 < p_max < 1, got {p_min}, {p_max}")
    t = F.lit(temperature) * (F.lit(1.0) + F.lit(slope) * F.greatest(spread - F.lit(pivot), F.lit(0.0)))
    return clamp(sigmoid(margin / t), p_min, p_max)


def type_posterior(d2: Column, temperature: float, bias: float, q_min: float, q_max: float) -> Column:
    return clamp(sigmoid(d2 / F.lit(temperature) + F.lit(bias)), q_min, q_max)


def compose_three(p_fake: Column, q: Column) -> Column:
    """[real, synthetic, semisynthetic]; the first entry does not depend on q."""
    return F.array(F.lit(1.0) - p_fake, p_fake * (F.lit(1.0) - q), p_fake * q)


def first_argmax(p: Column) -> Column:
    """Zero-based position of the largest entry, the first on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, Abramowitz-Stegun 7.1.26 (error below 1.5e-7)."""
    # Fixed values of the published approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    u = F.abs(x) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * u)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + F.lit(c)) * t
    erf = F.lit(1.0) - poly * F.exp(-u * u)
    return F.when(x >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).otherwise(F.lit(0.5) * (F.lit(1.0) - erf))


def probit(p: Column) -> Column:
    """Inverse of the normal distribution function, Acklam's rational form (relative error 1.2e-9)."""
    # Fixed values of the published approximation.
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
    low = 0.02425

    def poly(coef, x):
        out = F.lit(coef[0])
        for v in coef[1:]:
            out = out * x + F.lit(v)
        return out

    q = p - F.lit(0.5)
    r = q * q
    mid = poly(a, r) * q / (poly(b, r) * r + F.lit(1.0))
    ql = F.sqrt(F.lit(-2.0) * F.log(p))
    left = poly(c, ql) / (poly(d, ql) * ql + F.lit(1.0))
    qr = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    right = -poly(c, qr) / (poly(d, qr) * qr + F.lit(1.0))
    return F.when(p < low, left).when(p > 1.0 - low, right).otherwise(mid)


def auc_ceiling(auc: Column) -> Column:
    """Best balanced accuracy any threshold reaches at this AUC (equal-variance Gaussian)."""
    return normal_cdf(probit(clamp(auc, 1e-6, 1.0 - 1e-6)) / F.lit(2.0 ** 0.5))
