"""Personal data: candidate spans from generous patterns, scored by gradient-boosted trees, cut at calibrated thresholds.

Strict rules give the base spans, which always stand. Generators with more recall propose further, overlapping
spans of the same kinds. Boosted trees over format and context score the proposals; they learn from proposals that a base
span confirms or not, without seeing the marks by which the strict rules tell (the plus of a phone number, the kind
of at sign), and so carry over to formats that the rules don't know. A kind's threshold is the lowest score, one half
at least, above which at least ``precision`` of the proposals in all texts that the trees haven't learned from are confirmed; a
kind that never gets there adds nothing. The trees are fitted on three quarters of about ``sample`` texts, chosen by hash, of more
where these hold only one class, and run on all texts as a built-in expression, so that a row's proposals are made, scored and resolved where the row is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import SPANS, count_of, covered, found, joined, kept, let, luhn
from plumbline.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
SAMPLE, TREES, DEPTH, PRECISION, LEAST, SLICES, SEED = 20_000, 10, 3, 0.95, 0.5, 100, 5
BOTH = f"struct<base:{SPANS},spans:{SPANS}>"
ORDERED = "array<struct<start:int,kind:int,end:int>>"
_RUN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
_AT_START = r"(?:(?<![0-9])|\G)"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The strict rules. Possessive, and anchored where a run begins, so that the time is linear in the text.
BASE = (_RUN + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _AT_START + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9](?:[\x20-]?[0-9])++", r"\+[0-9][\x20().0-9-]+[0-9]")
#: The generators, kind by kind.
PROPOSE = (_RUN + r"\x20?(?:@|\((?:at|AT)\)|\[(?:at|AT)\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?[A-Za-z0-9-]++)*+",
           _AT_START + r"[0-9]{1,4}(?:[.,:\x20][0-9]{1,4}){3}(?![0-9])",
           _AT_START + r"[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])",
           r"(?:(?<![0-9+(])|\G)[+(]?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])")
CONTEXT = (r"tel|phone|call|fax|mobil|llam|appel", r"mail|contact|write|schreib|escrib", r"card|visa|karte|carte|tarjeta|pay|iban",
           r"\bip\b|host|server|addr|adress|login|version")
PROPOSALS = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: int, v: Column) -> Column:
    if kind == 1:
        return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == 2:
        return let(_digits(v), lambda d: F.length(d).between(16, 19) & luhn(d))
    return F.length(_digits(v)).between(8, 15) if kind == 3 else F.lit(True)


def base_spans(text: Column) -> Column:
    """The strict rules' spans, by kind as listed, then by start."""
    return F.concat(*[kept(found(text, p), k, lambda v, k=k: _valid(k, v)) for k, p in enumerate(BASE)])


def features(p: Column) -> Column:
    """Format and context of a proposal as numbers."""
    v, before = p["value"], F.lower(p["before"])
    last, after = F.right(before, F.lit(1)), F.left(p["after"], F.lit(1))
    groups = F.filter(F.split(v, "[^A-Za-z0-9]+", -1), lambda g: F.length(g) > 0)
    sizes = F.transform(groups, F.length)
    numbers = F.transform(groups, lambda g: F.coalesce(F.right(g, F.lit(9)).try_cast("int"), F.lit(999_999_999)))
    d = _digits(v)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return F.array(*[yes(p["kind"] == k) for k in range(len(KINDS))], *[F.coalesce(x.cast("double"), F.lit(0.0)) for x in (
        F.char_length(v), F.length(d), F.size(groups), F.get(sizes, 0), F.get(sizes, F.size(sizes) - 1), F.array_max(sizes), F.array_min(sizes),
        F.array_max(numbers))], yes(luhn(d)), yes(v.rlike(r"[.,:/-]")), yes(v.contains(" ")), yes(v.contains("(")),
        yes(last.rlike("[A-Za-z0-9]")), yes(last.rlike(r"\s")), yes(last == ""), yes(after.rlike("[A-Za-z0-9]")), yes(after.rlike(r"\s")),
        yes(after == ""), *[yes(before.rlike(c)) for c in CONTEXT])


def proposals(text: Column) -> Column:
    """array<struct<kind, start, end, value, before, after>>: what the generators propose, overlaps included."""
    def of(kind: int) -> Column:
        return F.transform(found(text, PROPOSE[kind], 24), lambda s: F.struct(
            F.lit(kind), s["start"], s["end"], s["value"], s["before"], s["after"])).cast(PROPOSALS)
    return F.concat(*map(of, range(len(KINDS))))


def may_hold(text: Column) -> Column:
    """False for texts that no pattern can match."""
    return text.rlike(r"[0-9@]|\((?:at|AT)\)|\[(?:at|AT)\]")


def _of_kind(spans: Column, kind: int | Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _tree(node, f: Column) -> Column:
    """A fitted tree as an expression over the features."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    at = node.split()
    return F.when(f[at.featureIndex()] <= float(at.threshold()), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


class Model:
    """Boosted trees and a threshold for each kind; without trees nothing is added."""

    def __init__(self, trees: Sequence = (), weights: Sequence[float] = (), thresholds: Sequence[float | None] = (None,) * len(KINDS)):
        self.trees, self.weights, self.thresholds = list(trees), list(weights), list(thresholds)

    def probability(self, f: Column) -> Column:
        margin = F.lit(0.0)
        for t, w in zip(self.trees, self.weights, strict=True):
            margin = margin + _tree(t, f) * float(w)
        return 1 / (1 + F.exp(-2 * margin))

    def chosen(self, p: Column) -> Column:
        """Whether a proposal's score reaches its kind's threshold."""
        least = F.array(*[F.lit(2.0 if t is None else float(t)) for t in self.thresholds])
        return let(features(p), self.probability) >= F.get(least, p["kind"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH,
        precision: float = PRECISION) -> Model:
    """Trees from the proposals in three quarters of about ``sample`` texts (of all, if there are fewer), thresholds from
    those in all other texts. While the trees' texts hold one class only, eight times as many are taken, up to all."""
    n, most = docs.count(), 1 << 40
    share = max(1, int(min(1.0, sample / max(n, 1)) * most))
    body = F.coalesce(F.col(text), F.lit(""))
    part = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text)), F.lit(SEED)), F.lit(1 << 40))
    rows = docs.select(part.alias("part"), body.alias("text")).filter(may_hold(F.col("text")))
    judged = let(base_spans(F.col("text")), lambda base: let(F.array(*[_of_kind(base, k) for k in range(len(KINDS))]), lambda by: F.transform(
        proposals(F.col("text")), lambda p: F.struct(p["kind"], features(p), covered(F.get(by, p["kind"]), p["start"], p["end"]).cast("double")))))

    def proposed(texts: DataFrame) -> DataFrame:
        return texts.select(F.explode(judged.cast("array<struct<kind:int,f:array<double>,y:double>>")).alias("p")).select("p.kind", "p.f", "p.y")

    while True:
        learned = (F.col("part") < share) & (F.col("part") % 4 != 3)
        early = cut_lineage(proposed(rows.filter(learned)).select("f", "y"))
        if early.select("y").distinct().count() == 2:
            break
        if share == most:
            return Model()
        share = min(8 * share, most)
    early = early.select(array_to_vector("f").alias("features"), "y")
    fitted = GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, seed=SEED, cacheNodeIds=False).fit(early)
    model = Model([t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in fitted.trees], fitted.treeWeights)
    late = proposed(rows.filter(~learned)).select("kind", F.floor(model.probability(F.col("f")) * SLICES).alias("slice"), "y")
    counts = late.groupBy("kind", "slice").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    for k in range(len(KINDS)):
        right = seen = 0.0
        for r in sorted((r for r in counts if r["kind"] == k), key=lambda r: -r["slice"]):
            right, seen = right + r["y"], seen + r["n"]
            if right >= precision * seen:
                model.thresholds[k] = max(LEAST, r["slice"] / SLICES)
    return model


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, base and spans, arrays of struct<kind, start, end> by kind, then start.

    ``spans`` are the base spans and the chosen proposals that overlap none of them; of chosen ones that overlap each other
    the first by start, then by kind, is kept. Null and empty texts hold nothing; rows are judged alone, so repeats
    get equal spans; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")

    def resolved(base: Column) -> Column:
        return let(F.array(*[_of_kind(base, k) for k in range(len(KINDS))]), lambda by: with_added(base, by))

    def with_added(base: Column, by: Column) -> Column:
        def free(p: Column) -> Column:
            out = ~covered(F.get(by, F.lit(0)), p["start"], p["end"])
            for k in range(1, len(KINDS)):
                out &= ~covered(F.get(by, F.lit(k)), p["start"], p["end"])
            return out
        new = F.filter(proposals(body), lambda p: free(p) & model.chosen(p))
        ordered = F.array_sort(F.transform(new, lambda p: F.struct(p["start"], p["kind"], p["end"])).cast(ORDERED))
        none = F.struct(F.lit(0).alias("upto"), F.array().cast(ORDERED).alias("out"))
        apart = F.aggregate(ordered, none, lambda s, p: F.when(p["start"] >= s["upto"], F.struct(
            p["end"].alias("upto"), F.concat(s["out"], F.array(p)).alias("out"))).otherwise(s), lambda s: s["out"])
        added = F.transform(apart, lambda p: F.struct(p["kind"], p["start"], p["end"])).cast(SPANS)
        return F.struct(base, F.array_sort(F.concat(base, added)))
    both = let(base_spans(body), resolved if model.trees else lambda b: F.struct(b, b)).cast(BOTH)
    none = F.array().cast(SPANS)
    some = F.when(may_hold(body), both).otherwise(F.struct(none, none).cast(BOTH))
    return rows.select(F.col("id").alias(key), some.alias("both")).select(key, "both.base", "both.spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans merge into the first."""
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(ordered, start, lambda a, s: F.when(s["start"] >= a["upto"], F.struct(s["end"].alias("upto"), F.concat(
        a["out"], F.array(F.substring(text, a["upto"] + 1, s["start"] - a["upto"]), F.element_at(name, s["kind"] + 1))).alias("out"))).otherwise(
        F.struct(F.greatest(a["upto"], s["end"]).alias("upto"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["upto"] + 1, F.char_length(text))))


def counted(found_spans: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    rest = [c for c in found_spans.columns if c not in ("base", "spans")]
    return found_spans.select(*rest, *[count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                              F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
