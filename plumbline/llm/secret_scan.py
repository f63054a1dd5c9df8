"""Secret scan behind a trigram inverted index.

Every rule is a regular expression. From its structure follows a Boolean query over trigrams, alternatives of sets that
a match must contain in lower case. The index holds postings (trigram, document) for the trigrams that some query
asks for; intersecting a document's postings gives the rules that may match, and only these are run on its text. A
rule without mandatory trigrams is run on every text. Texts are shuffled only where a bounded Bloom filter says that
they may be candidates; the others are scanned where they are read.
"""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import filter_bits, key_filter, maybe_in
from plumbline.llm.spans import count_of, found, joined, kept
from plumbline.session import cut_lineage

PER_ROW, MOST_BITS = 16, 2**31
#: Literal strings that a part of a rule may stand for; beyond that it counts as anything.
STRINGS, CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A match counts where group ``group`` has ``least`` characters or more."""
    name: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Formats of published kinds of keys.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE + FURTHER

#: Alternatives, each a set of trigrams that must all occur; one empty set: no condition.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a pattern, over lower-cased text."""
    strings, query = _part(parser.parse(pattern))
    return _simple(_both(query, _grams(strings)) if strings is not None else query)


def _grams(strings: set[str]) -> Query:
    return _simple(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _simple(q: Query) -> Query:
    """Without alternatives that others include."""
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(a: Query, b: Query) -> Query:
    return _simple(frozenset(x | y for x in a for y in b))


def _part(items) -> tuple[set[str] | None, Query]:
    """(the strings that a sequence can be, or None if there are many; what a match needs besides)."""
    run, query, whole = {""}, ANY, True
    for kind, arg in items:
        strings, needs = _item(kind, arg)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a, b in itertools.product(run, strings)}
        else:
            query, whole = _both(query, _grams(run)), False
            run = strings if strings is not None else {""}
        query = _both(query, needs)
    if whole:
        return run, query
    return None, _both(query, _grams(run))


def _item(kind, arg) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(arg).lower()}, ANY
    if kind is op.IN:
        chars = {chr(v).lower() for k, v in arg if k is op.LITERAL}
        return (chars, ANY) if all(k is op.LITERAL for k, _ in arg) and len(chars) <= CLASS else (None, ANY)
    if kind is op.SUBPATTERN:
        return _part(arg[-1])
    if kind is op.BRANCH:
        parts = [_part(p) for p in arg[1]]
        if all(s is not None and q == ANY for s, q in parts):
            return set().union(*(s for s, _ in parts)), ANY
        return None, _simple(frozenset().union(*(_both(q, _grams(s)) if s is not None else q for s, q in parts)))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, needs = _part(body)
        if (least, most) == (0, 1) and strings is not None and needs == ANY:
            return strings | {""}, ANY
        if least == most == 1:
            return strings, needs
        return None, (_both(needs, _grams(strings)) if strings is not None else needs) if least else ANY
    return None, ANY


def postings(docs: DataFrame, grams: Sequence[str], key: str, text: str) -> DataFrame:
    """(gram, id): the index over the given trigrams of lower-cased texts."""
    rows = docs.select(F.col(key).alias("id"), F.lower(text).alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return rows.select("id", F.explode(has).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], key: str, text: str) -> DataFrame:
    """(id, rules): numbers of the rules with a trigram query that it meets, for ids that meet one."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted({g for q in queries.values() for alternative in q for g in alternative})

    def meets(q: Query) -> Column:
        out = F.lit(False)
        for alternative in sorted(map(sorted, q)):
            out |= F.size(F.array_except(F.array(*map(F.lit, alternative)), "grams")) == 0
        return out
    met = F.array_compact(F.array(*[F.when(meets(q), F.lit(k)) for k, q in queries.items()])) if queries else F.array().cast("array<int>")
    by_id = postings(docs, grams, key, text).groupBy("id").agg(F.collect_set("gram").alias("grams"))
    return cut_lineage(by_id.select("id", met.alias("rules")).filter("size(rules) > 0"))


def _spans(rules: Sequence[Rule], run: Sequence[int], met: Column | None) -> Column:
    """Spans of the rules that are run, those of others only where ``met`` has their number."""
    each = []
    for k, r in enumerate(rules):
        if k in run or met is not None:
            def long_enough(v: Column, r: Rule = r) -> Column:
                return F.char_length(F.regexp_extract(v, r.pattern, r.group) if r.group else v) >= r.least
            s = kept(found(F.col("text"), r.pattern), k, long_enough)
            each.append(s if k in run else F.when(F.array_contains(met, k), s).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>")))
    spans = F.concat(*each) if each else F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key and spans, array<struct<start, kind, end>> by start, then by number of the rule.

    Null and empty texts hold nothing. Candidates are kept by key: rows that share one, or have none, are candidates
    together, and each text is verified by itself, so repeats get equal spans. An empty table gives an empty result;
    other columns are not read.
    """
    everywhere = [k for k, r in enumerate(rules) if trigram_query(r.pattern) == ANY]
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = candidates(docs, rules, key, text)
    bits = filter_bits(met.count(), PER_ROW, MOST_BITS, 2)
    flagged = maybe_in(rows, F.col("id"), key_filter(met, "id", bits), bits, 2, "maybe")
    sure = flagged.filter("not maybe").select("id", _spans(rules, everywhere, None).alias("spans"))
    may = flagged.filter("maybe").join(met.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")), "left")
    may = may.select("id", _spans(rules, everywhere, F.coalesce("rules", F.array().cast("array<int>"))).alias("spans"))
    return sure.union(may).select(F.col("id").alias(key), "spans")


def counted(spans: DataFrame, rules: Sequence[Rule] = RULES, base: int = len(BASE)) -> DataFrame:
    """Counts and digest of the first ``base`` rules' spans, and all spans as text."""
    own = F.filter("spans", lambda s: s["kind"] < base)
    names = [r.name for r in rules]
    rest = [c for c in spans.columns if c != "spans"]
    return spans.select(*rest, *[count_of(F.col("spans"), k).alias(f"n_{names[k]}") for k in range(base)],
                        F.sha2(joined(own, names), 256).alias("base_sha256"), joined(F.col("spans"), names).alias("spans"))
