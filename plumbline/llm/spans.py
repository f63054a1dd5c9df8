"""Spans that a regular expression finds in a text, with offsets, in built-in functions only.

Spark gives a pattern's matches and the pieces between them, but no offsets; these are running sums of their lengths.
Patterns are Java's. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a running sum that are added one by one; whole blocks of as many come from a second level.
BLOCK = 256
SPANS = "array<struct<kind:int,start:int,end:int>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often and however deep it is used."""
    return F.transform(F.array(value), then)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def running_sums(values: Column) -> Column:
    """Running sums of an array of ints, with about BLOCK + n / BLOCK additions for each of n items."""
    def with_blocks(v: Column, blocks: Column) -> Column:
        return F.transform(v, lambda _, i: total(F.slice(blocks, 1, F.floor(i / BLOCK).cast("int"))) + total(
            F.slice(v, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1)))

    def blocks_of(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    return let(values, lambda v: let(blocks_of(v), lambda blocks: with_blocks(v, blocks)))


def found(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start:int,end:int,value:string>> of the leftmost non-overlapping matches, in order; with ``context`` also
    ``before`` and ``after``: so many characters at most on either side, up to the neighbouring match."""
    kind = "start:int,end:int,value:string" + ",before:string,after:string" * bool(context)

    def of(matches: Column, pieces: Column) -> Column:
        first, next_ = F.slice(pieces, 1, F.size(matches)), F.slice(pieces, 2, F.size(matches))
        sizes = F.zip_with(matches, first, lambda m, p: F.char_length(m) + F.char_length(p))
        spans = F.zip_with(matches, running_sums(sizes), lambda m, e: F.struct(e - F.char_length(m), e, m).cast("struct<s:int,e:int,v:string>"))
        if not context:
            return spans
        around = F.zip_with(first, next_, lambda a, b: F.struct(F.right(a, F.lit(context)), F.left(b, F.lit(context))).cast("struct<b:string,a:string>"))
        return F.zip_with(spans, around, lambda s, c: F.struct(s["s"], s["e"], s["v"], c["b"], c["a"]))
    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: of(m, p)))
    return F.when(text.rlike(pattern), some.cast(f"array<struct<{kind}>>")).otherwise(F.array().cast(f"array<struct<{kind}>>"))


def kept(spans: Column, kind: int, keep: Callable[[Column], Column]) -> Column:
    """array<struct<kind:int,start:int,end:int>> of the spans whose value passes."""
    return F.transform(F.filter(spans, lambda s: keep(s["value"])), lambda s: F.struct(
        F.lit(kind), s["start"], s["end"])).cast(SPANS)  # names given inside nested functions are not always kept


def joined(spans: Column, names: Sequence[str]) -> Column:
    """kind:start:end of the spans in their order, comma-joined."""
    name = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def covered(sorted_spans: Column, start: Column, end: Column) -> Column:
    """Whether one of an array's spans, in order and apart from each other, meets [start, end). A binary search."""
    steps = F.array(*[F.lit(2**k) for k in range(30, -1, -1)])
    size = F.size(sorted_spans)
    before = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= size) & (F.get(sorted_spans, n + k - 1)["start"] < end), n + k).otherwise(n))
    return let(before, lambda n: F.coalesce(F.get(sorted_spans, n - 1)["end"] > start, F.lit(False)))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))
