"""Score formulas as column expressions over sums that are already aggregated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score: exponents, and the Brier of an uninformed guess.
SCORE_ALPHA = 1.2
SCORE_BETA = 1.8
BRIER_BASE_BINARY = 0.25
BRIER_BASE_THREE = 2.0 / 3.0


def safe_ratio(num: Column, den: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.when(den != 0, num / den)


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)


def quality_score(mcc_: Column, brier: Column, base: float = BRIER_BASE_BINARY) -> Column:
    """sqrt(((mcc + 1) / 2)^1.2 * max(0, (base - brier) / base)^1.8)."""
    m = F.pow(F.greatest((mcc_ + 1.0) / 2.0, F.lit(0.0)), F.lit(SCORE_ALPHA))
    b = F.pow(F.greatest((F.lit(base) - brier) / F.lit(base), F.lit(0.0)), F.lit(SCORE_BETA))
    return F.sqrt(m * b)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return (F.when((n1 == 0) | (n2 == 0), F.lit(None).cast("double"))
            .when(se == 0, 0.0).otherwise((k1 / n1 - k2 / n2) / se))


def gorodkin(conf: list[list[Column]]) -> Column:
    """R_K correlation from a K x K table of summed weights, rows true and columns predicted."""
    k = len(conf)

    def total(cols):
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    s = total([c for row in conf for c in row])
    hit = total([conf[i][i] for i in range(k)])
    t = [total(conf[i]) for i in range(k)]
    p = [total([conf[i][j] for i in range(k)]) for j in range(k)]
    tp = total([t[i] * p[i] for i in range(k)])
    pp = total([p[i] * p[i] for i in range(k)])
    tt = total([t[i] * t[i] for i in range(k)])
    den = F.sqrt((s * s - pp) * (s * s - tt))
    return F.when(den > 0, (hit * s - tp) / den).otherwise(0.0)


def verdict(value: Column, warn: Column, hard: Column, higher_is_bad: Column | bool = True) -> Column:
    """ok / warn / hard with strict comparison; an undefined value is ok."""
    flip = F.lit(higher_is_bad) if isinstance(higher_is_bad, bool) else higher_is_bad
    v = F.when(flip, value).otherwise(-value)
    return F.when(v > hard, "hard").when(v > warn, "warn").otherwise("ok")
