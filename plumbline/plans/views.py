"""Per row and epoch, what a renderer should do to an item: codec, resampling, effect, flips, view.

Only the plan is made here. Every decision has a hash uniform of its own, so switching one part on or
off, or changing it from one epoch to the next, never moves another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalar as S

# The effects a plan may name, and what an epoch may change.
EFFECTS = ("motion_blur", "defocus_blur", "film_grain", "halftone", "oversharpen", "sensor_noise",
           "banding", "color_cast", "vignette", "chroma_shift")
SCHEDULABLE = ("codec_jpeg_p", "codec_double_p", "codec_jpeg_q", "codec_webp_q", "jitter_p", "jitter_range",
               "jitter_kernels", "effects_p", "effects", "effects_strength", "robust_skip_webp_p", "crop_guard",
               "view_arms", "view_b")


# The defaults of the plan.
@dataclass(frozen=True)
class ViewPlan:
    codec: bool = True
    codec_none_p: float = 0.30
    codec_jpeg_p: float = 0.45
    codec_double_p: float = 0.0
    codec_jpeg_q: tuple[int, int] = (55, 98)
    codec_webp_q: tuple[int, int] = (60, 95)
    codec_shift: tuple[int, int] = (1, 7)
    jitter: bool = True
    jitter_p: float = 0.4
    jitter_range: tuple[float, float] = (0.60, 1.0)
    jitter_kernels: tuple[str, ...] = ("area_linear",)
    effects_p: float = 0.0
    effects: tuple[tuple[str, float], ...] = ()
    effects_strength: tuple[float, float] = (0.25, 1.0)
    hflip_p: float = 0.5
    vflip_p: float = 0.5
    view_arms: tuple[float, float, float] = (0.80, 0.10, 0.10)
    ladder_levels: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)
    crop_guard: bool = True
    robust_skip_webp_p: float = 0.0
    view_b: str = "robust"

    def problems(self) -> list[str]:
        out = []
        if abs(sum(self.view_arms) - 1.0) > 1e-6:
            out.append(f"view arms sum to {sum(self.view_arms):.4f}")
        if self.codec_none_p + self.codec_jpeg_p + self.codec_double_p > 1.0 + 1e-9:
            out.append("codec arms exceed 1")
        if len(self.ladder_levels) != 4 or min(self.ladder_levels) < 0 or abs(sum(self.ladder_levels) - 1.0) > 1e-6:
            out.append(f"ladder levels need four shares that sum to 1: {self.ladder_levels}")
        unknown = sorted({n for n, _ in self.effects} - set(EFFECTS))
        if unknown:
            out.append(f"unknown effects {unknown}")
        if any(w <= 0 for _, w in self.effects):
            out.append("effect weights must be positive")
        if self.view_b not in ("robust", "deploy"):
            out.append(f"view_b is {self.view_b!r}")
        return out

    def checked(self) -> "ViewPlan":
        bad = self.problems()
        if bad:
            raise ValueError("; ".join(bad))
        return self

    def at(self, changes: Mapping[str, object]) -> "ViewPlan":
        """One epoch's profile; parts that switch a stage on or off are not schedulable."""
        bad = sorted(set(changes) - set(SCHEDULABLE))
        if bad:
            raise ValueError(f"an epoch may not change {bad}")
        return replace(self, **changes).checked()


def pick(u: Column, names: Sequence[str], weights: Sequence[float]) -> Column:
    """The name whose slice of the weights holds u; the last one takes what is left."""
    total, acc, out = float(sum(weights)), 0.0, F
    for n, w in list(zip(names, weights))[:-1]:
        acc += w / total
        out = out.when(u < F.lit(acc), n)
    return F.lit(names[-1]) if out is F else out.otherwise(names[-1])


def _between(u: Column, lo: int, hi: int) -> Column:
    return (F.floor(u * (hi - lo + 1)) + lo).cast("int")


def _decisions(p: ViewPlan, u) -> dict[str, Column]:
    none = F.lit(None)
    arm = pick(u("codec"), ["none", "jpeg", "double", "webp"],
               [p.codec_none_p, p.codec_jpeg_p, p.codec_double_p, 1.0 - p.codec_none_p - p.codec_jpeg_p - p.codec_double_p])
    arm = arm if p.codec else F.lit("none")
    q = F.when(arm.isin("jpeg", "double"), _between(u("quality"), *p.codec_jpeg_q)).when(arm == "webp", _between(u("quality"), *p.codec_webp_q))
    shifted = arm == "double"
    lo, hi = p.jitter_range
    factor = F.lit(lo) + u("factor") * F.lit(hi - lo)
    jit = (u("jitter") < p.jitter_p) & (factor < 0.999) if p.jitter else F.lit(False)
    kernel = pick(u("kernel"), p.jitter_kernels, [1.0] * len(p.jitter_kernels))
    fx = u("effect_gate") < p.effects_p if p.effects else F.lit(False)
    name = pick(u("effect"), *zip(*p.effects)) if p.effects else none.cast("string")
    slo, shi = p.effects_strength
    view = pick(u("view"), ["deploy", "ladder", "robust"], p.view_arms)
    level = pick(u("level"), ["0", "1", "2", "3"], p.ladder_levels).cast("int")
    guard = (F.col("kind") == "semisynthetic") if p.crop_guard else F.lit(False)
    return {
        "codec_arm": arm, "codec_quality": q, "second_quality": F.when(shifted, _between(u("quality2"), *p.codec_jpeg_q)),
        "shift_x": F.when(shifted, _between(u("shift_x"), *p.codec_shift)), "shift_y": F.when(shifted, _between(u("shift_y"), *p.codec_shift)),
        "jitter_factor": F.when(jit, factor), "jitter_kernel": F.when(jit, kernel),
        "effect": F.when(fx, name), "effect_strength": F.when(fx, F.lit(slo) + u("strength") * F.lit(shi - slo)), "effect_aux": F.when(fx, u("aux")),
        "hflip": u("hflip") < p.hflip_p, "vflip": u("vflip") < p.vflip_p,
        "view_a": view, "view_b": F.lit(p.view_b), "ladder_level": F.when(view == "ladder", level),
        "crop_p": F.when(view == "ladder", F.when(guard, 0.0).otherwise(0.5)),
        "skip_webp": (view == "robust") & (u("skip_webp") < p.robust_skip_webp_p),
    }


def view_plan(rows: DataFrame, base: ViewPlan, schedule: Sequence[Mapping[str, object]], epochs: int, seed: int,
              row_index: str = "file_index") -> DataFrame:
    """One row per item and epoch. Epoch e follows profile e mod len(schedule)."""
    profiles = [base.checked().at(c) for c in (schedule or [{}])]
    r = rows.select("image_id", "kind", row_index, F.explode(F.array(*[F.lit(e) for e in range(epochs)])).alias("epoch"))
    r = r.withColumn("profile", (F.col("epoch") % len(profiles)).cast("int"))
    key = F.concat_ws("|", "image_id", F.col("epoch").cast("string"))

    def u(name: str) -> Column:
        return S.stable_fraction(key, f"{seed}|{name}")

    made = [_decisions(p, u) for p in profiles]
    cols = []
    for name in made[0]:
        out = made[-1][name]
        for i in range(len(made) - 2, -1, -1):
            out = F.when(F.col("profile") == i, made[i][name]).otherwise(out)
        cols.append(out.alias(name))
    return r.select("image_id", "epoch", "profile", S.epoch_row_seed(F.col(row_index), seed, F.col("epoch")).alias("row_seed"), *cols)
