"""Spelling variants: words one edit apart, found by search schemes over FM-indexes in both directions.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Cut a word in two halves: the edit
touches one of them at most, so the other half is matched exactly and the search goes on across the first, allowing one error. A
scheme starts at the delimiter that its exact half touches; left halves are matched in the index of the reversed words,
right halves in the index of the words, and both searches narrow one interval of suffix ranks a symbol at a time.

The vocabulary is dealt to shards by half: a word of length m is filed under its first (m - 1) // 2, m // 2 and (m + 1) // 2 code points and
again under its last ones, and asks under m // 2 and m - m // 2 of its own. All words that a query may match stand in its
shard, nothing else has to be read. The words filed under one half are cut into blocks of ``BLOCK`` words, and the queries
of such a half go to every block of it. A word has a number of near words that is bounded by its length and the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lookup, sliced
from plumbline.session import cut_lineage

#: Words that one index holds, queries that are searched at a time, and words that a task counts before it hands them on.
BLOCK, AT_ONCE, COUNTED = 100_000, 20_000, 400_000
RUN = re.compile("[a-zÀ-ÿ]+")
END, MARK = 0, 1  # symbols of an index: end of its text, delimiter between words


def _counts(batches: Iterator[pa.RecordBatch], least: int, slip: int | None) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    for batch, texts in sliced(batches, "text"):
        for key, t in zip(batch.column("id").to_pylist(), texts, strict=True):
            line = (t or b"").lower().decode()
            own = Counter(m[0] for m in RUN.finditer(line)) if len(line) > 1 << 22 else Counter(RUN.findall(line))
            for w, n in own.items():
                if slip and (h := zlib.crc32(f"{'' if key is None else key}:{w}".encode())) % slip == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                if len(w) >= least:
                    total[w] += n
            if len(total) > COUNTED:
                yield out()
                total.clear()
    yield out()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5,
               slip: int | None = None) -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of ``least_length`` code points or more and
    ``least_count`` occurrences or more. Null and empty texts have no words; the table may be empty; repeated rows count again.

    ``slip`` plants slips: let h be the CRC-32 of ``<key>:<run>`` (a null key is empty); if ``slip`` divides h, the run loses
    code point h % length. Counts are added up in each task before they are shuffled.
    """
    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(lambda b: _counts(b, least_length, slip), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array by doubling, from ranks of as many symbols as fit 62 bits."""
    bits = max(1, int(symbols - 1).bit_length())
    span, n = max(1, 62 // bits), len(text)
    padded = np.append(text, np.zeros(span, np.int64))
    rank = np.zeros(n, np.int64)
    for i in range(span):
        rank = (rank << bits) | padded[i : i + n]
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.append(0, np.cumsum(rank[order][1:] != rank[order][:-1])) + 1
        if new.max() == n:
            return order
        rank = new * (n + 1)
        rank[: n - span] += new[span:]
        span *= 2


class Index:
    """FM-index of distinct words set apart by delimiters; ``narrow`` puts a symbol before what an interval matches.

    Ranks are read off one sorted array of symbol * size + row for the rows of the transform: the number of entries below
    symbol * size + row is the rank that the row maps to.
    """

    def __init__(self, words: list[str]) -> None:
        points = np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le"), np.uint32)  # no word has a line break
        self.alphabet = np.unique(points[points != 10])
        text = np.where(points == 10, MARK, np.searchsorted(self.alphabet, points) + 2).astype(np.int64)
        text = np.append(text, END)
        self.symbols, self.size = len(self.alphabet) + 2, len(text)
        order = _suffix_order(text, self.symbols)
        self.before = text[order - 1]
        self.ranks = np.sort(self.before * self.size + np.arange(self.size))
        marks = np.flatnonzero(text == MARK)
        at = np.searchsorted(marks, order)
        self.word = np.where(text[order] == MARK, at, -1)  # of a suffix that begins with a word's delimiter

    def narrow(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.ranks, symbol * self.size + lo), np.searchsorted(self.ranks, symbol * self.size + hi)

    def choices(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol): letters that may stand before what each interval matches; distinct for each interval."""
        width = hi - lo
        few = np.flatnonzero(width <= self.symbols)
        n = width[few]
        own = np.repeat(few, n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[own]
        seen = np.unique(own * self.symbols + self.before[rows])
        many = np.flatnonzero(width > self.symbols)
        every = (many[:, None] * self.symbols + np.arange(2, self.symbols)).ravel()
        both = np.concatenate([seen[seen % self.symbols > MARK], every])
        return both // self.symbols, both % self.symbols

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): all words that differ from a query in one edit and end with its last ``exact`` code points."""
        length = np.array([len(q) for q in queries])
        points = np.frombuffer("".join(q[::-1] for q in queries).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        code = np.where(self.alphabet[at] == points, at + 2, -1)
        start = np.cumsum(length) - length
        code = np.append(code, MARK)

        def symbol(q: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Symbol j of query q as it is read, from its last; after the first comes the delimiter, then nothing."""
            return np.where(j < length[q], code[np.minimum(start[q] + j, len(code) - 1)], np.where(j == length[q], MARK, -1))

        q, j = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        lo, hi = self.narrow(np.full(len(q), MARK), j, j + self.size)
        off: list[tuple[np.ndarray, ...]] = []  # intervals with their error behind them
        while len(q):
            c = symbol(q, j)
            free = j >= exact[q]
            last = symbol(q, j + 1) != c  # of equal code points the last is the one that is missing
            gone = free & (j < length[q]) & last
            off.append((q[gone], j[gone] + 1, lo[gone], hi[gone]))
            f = np.flatnonzero(free)
            k, other = self.choices(lo[f], hi[f])
            k = f[k]
            k, other = k[other != c[k]], other[other != c[k]]
            x, y = self.narrow(other, lo[k], hi[k])
            k, x, y = k[x < y], x[x < y], y[x < y]
            off.append((q[k], j[k], x, y))
            put = j[k] < length[q[k]]
            off.append((q[k][put], j[k][put] + 1, x[put], y[put]))
            x, y = self.narrow(np.maximum(c, 0), lo, hi)
            on = (x < y) & (c >= 0) & (j < length[q])
            q, j, lo, hi = q[on], j[on] + 1, x[on], y[on]
        q, j, lo, hi = (np.concatenate(x) for x in zip(*off, strict=True)) if off else (q, j, lo, hi)
        found = []
        while len(q):
            c = symbol(q, j)
            x, y = self.narrow(np.maximum(c, 0), lo, hi)
            on = (x < y) & (c >= 0)
            done = on & (j == length[q])
            found.append((q[done], self.word[x[done]]))
            on &= ~done
            q, j, lo, hi = q[on], j[on] + 1, x[on], y[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, w = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(q * (len(self.word) + 1) + w)
        return both // (len(self.word) + 1), both % (len(self.word) + 1)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each block of a shard; the rows come ordered by ``left``, ``half`` and ``block``."""
    kept: dict[tuple, list] = {}
    size, last = 0, None
    for batch in batches:
        for side, half, block, word, n, asks in zip(*(batch.column(c).to_pylist() for c in ("left", "half", "block", "word", "n", "asks")), strict=True):
            place = (side, half, block)
            if last is not None and place != last and (size >= BLOCK or side != last[0]):
                yield from _pairs(kept, last[0])
                kept, size = {}, 0
            kept.setdefault("asks" if asks else "filed", []).append((word, n))
            size += not asks
            last = place
    if last is not None:
        yield from _pairs(kept, last[0])


def _pairs(kept: dict[str, list], left: bool) -> Iterator[pa.RecordBatch]:
    filed = list(dict(kept.get("filed", [])).items())
    asked = list(dict(kept.get("asks", [])))
    if not filed:
        return
    turn = (lambda w: w[::-1]) if left else (lambda w: w)
    index = Index([turn(w) for w, _ in filed])
    for i in range(0, len(asked), AT_ONCE):
        some = asked[i : i + AT_ONCE]
        exact = np.array([len(w) // 2 if left else len(w) - len(w) // 2 for w in some])
        q, w = index.near([turn(x) for x in some], exact)
        yield pa.RecordBatch.from_pydict({"word": pa.array([some[k] for k in q.tolist()], pa.string()), "near": pa.array([filed[k][0] for k in w.tolist()], pa.string()),
                                          "near_n": pa.array([filed[k][1] for k in w.tolist()], pa.int64())})


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of the table ``words(word, n)`` that are one edit apart, in both orders.

    Words are distinct, not null and of two code points or more; case and form count. An empty table gives no pairs.
    """
    def part(left: bool, size) -> F.Column:
        half = F.substring("word", F.lit(1), size) if left else F.expr("word").substr(F.length("word") - size + 1, size)
        return F.struct(F.lit(left).alias("left"), F.xxhash64(F.lit(left), half).alias("half"))

    m = F.length("word")
    # The queries' halves: m // 2 from the left, the rest from the right; queries are a code point shorter or longer at most.
    shorter = lambda k: F.floor((m + k) / 2).cast("int")
    right = lambda k: (m + k - F.floor((m + k) / 2)).cast("int")
    filed = [part(True, shorter(k)) for k in (-1, 0, 1)] + [part(False, right(k)) for k in (-1, 0, 1)]
    index = words.select("word", "n", F.explode(F.array_distinct(F.array(*filed))).alias("p")).select("p.*", "word", "n")
    index = cut_lineage(index)
    full = index.groupBy("left", "half").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
    blocks = cut_lineage(full.select(F.col("left").alias("l"), F.col("half").alias("h"), F.ceil(F.col("c") * 2 / BLOCK).cast("int").alias("blocks")))
    asks = words.select("word", "n", F.explode(F.array(part(True, shorter(0)), part(False, right(0)))).alias("p")).select("p.*", "word", "n")
    same = (F.col("left") == F.col("l")) & (F.col("half") == F.col("h"))
    many = F.coalesce("blocks", F.lit(1))
    filed_rows = lookup(index, blocks, same).select("left", "half", F.pmod(F.xxhash64("word"), many).cast("int").alias("block"), "word", "n", F.lit(False).alias("asks"))
    asked_rows = lookup(asks, blocks, same).select("left", "half", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), "word", "n", F.lit(True).alias("asks"))
    dealt = filed_rows.union(asked_rows).repartition("half", "block").sortWithinPartitions("left", "half", "block")
    return dealt.mapInArrow(_search, "word string, near string, near_n long").distinct()


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """One row per row of ``words(word, n)``: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is ``times`` the word's own or
    more, else null. The root is the end of the chain of forms, the word itself if it has none. Counts grow ``times``-fold along a chain, so
    it has 27 steps at most for ``times`` 5, and pointers that double their reach find its end in five rounds.
    """
    words = cut_lineage(words)
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    strong = F.col("near_n") >= F.col("n") * times
    own = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    ends = own.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("on"))
        ends = cut_lineage(ends.join(further, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        if ends.filter("moved").isEmpty():
            break
    return own.join(ends.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
