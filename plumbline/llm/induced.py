"""External induced sorting of all suffixes of one block of bytes, with their common prefixes.

The order of a few suffixes gives the order of all: a suffix is its first symbol and a shorter suffix, so when suffixes are taken in
order and each hands the one before it to a queue, every symbol's stretch of the queue is filled in order. One pass upwards induces
the suffixes that fall (L), one pass downwards those that rise (S), both from the lowest points (S after L). The substrings between
lowest points are sorted as tuples and named, and the string of the names is sorted by recursion.

A queue is an array of slots, a stretch for each symbol: its priority is (symbol, rank of the suffix behind), and it is written in
order within each stretch and read once from end to end. Entries carry a position and the length of the common prefix with the
entry before, up to ``CAP``: that of two entries of one symbol is one more than the least value between the suffixes that
handed them over. Queues beyond ``ROOM`` bytes, and texts, types and names of such blocks, lie in files without a name, gone with the task; what is
held in memory then is one block of ``STEP`` entries at a time.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes up to which an array stays in memory; entries that are handled at a time.
ROOM, STEP = 64 << 20, 1 << 16
#: Common prefixes are told up to this length; UNKNOWN marks those that are measured when a pass comes to them.
CAP, UNKNOWN = 200, 255
#: Filled slots up to which entries are handled one by one.
FEW = 128


def array(n: int, kind: type, fill: int | None = None) -> np.ndarray:
    """An array in memory, or beyond ROOM bytes in a file that has no name and is gone when the array is."""
    out = np.empty(n, kind) if n * np.dtype(kind).itemsize <= ROOM else np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))
    if fill is not None:
        out[:] = fill
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one behind it (type S); the last is not, for the end is smallest."""
    n = len(text)
    out = array(n, bool)
    after, value = False, -1  # type and symbol behind the block
    for hi in range(n, 0, -STEP):
        lo = max(0, hi - STEP)
        x = np.append(text[lo:hi].astype(np.int64), value)
        turn = np.flatnonzero(x[1:] != x[:-1])
        up = np.append(x[turn] < x[turn + 1], after)
        out[lo:hi] = up[np.searchsorted(turn, np.arange(hi - lo))]
        after, value = out[lo], int(x[0])
    return out


def lowest(kind: np.ndarray) -> np.ndarray:
    """Positions of type S behind one of type L, in text order."""
    parts = [np.flatnonzero(kind[lo + 1 : lo + 1 + STEP] & ~kind[lo : lo + STEP][: len(kind) - lo - 1]) + lo + 1 for lo in range(0, len(kind), STEP)]
    total = sum(map(len, parts))
    out, at = array(total, np.int64), 0
    for p in parts:
        out[at : at + len(p)] = p
        at += len(p)
    return out


def tally(text: np.ndarray, symbols: int, only: np.ndarray | None = None) -> np.ndarray:
    """How often each symbol occurs, at all or where ``only`` says so."""
    out = np.zeros(symbols, np.int64)
    for lo in range(0, len(text), 1 << 20):
        x = text[lo : lo + (1 << 20)]
        out += np.bincount(x if only is None else x[only[lo : lo + (1 << 20)]], minlength=symbols)
    return out


def measured(text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at x and at y, up to CAP, eight bytes at a time."""
    n = len(text)
    out, left = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in range(0, CAP, 8):
        a, b = (np.minimum(p[left, None] + at + np.arange(8), n - 1) for p in (x, y))
        same = np.logical_and.accumulate(text[a] == text[b], axis=1).sum(1)
        out[left] += same
        left = left[same == 8]
        if not len(left):
            break
    return np.minimum(np.minimum(out, CAP), n - np.maximum(x, y))


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo + 1 : hi + 1] for each pair, lo < hi, by minima over powers of two."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    table, k = values, 0
    while len(lo):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[lo[own] + 1], table[hi[own] + 1 - (1 << k)])
        k += 1
        if k > level.max(initial=0):
            break
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
    return out


def _pass(text: np.ndarray, kind: np.ndarray, wanted: bool, queue: np.ndarray, shared: np.ndarray | None, head: np.ndarray) -> None:
    """Read ``queue`` from end to end; every suffix hands over the one before it where that has the wanted type.

    ``head`` is the first free slot of each symbol's stretch and moves on. ``shared``, if given, has the common prefix
    of each entry with the one read before it, and one more place.
    """
    n, at, width = len(queue), 0, 1 << 10
    begin = head.copy()
    since = np.full(len(head), CAP, np.uint8)  # least common prefix since a symbol's last entry was handed over
    if not wanted:  # the end of the text hands over the last suffix before anything is read
        last = int(text[len(text) - 1])
        queue[head[last]] = len(text) - 1
        head[last] += 1
        if shared is not None:
            since[last] = 0
    views = [None if x is None else memoryview(x) for x in (text, kind, queue, shared, head, begin)]
    while at < n:
        some = np.asarray(queue[at : at + width])
        free = some < 0
        size = int(free.argmax()) if free.any() else len(some)
        width = min(STEP, max(64, 2 * size))
        if size < FEW:  # entries that wait for each other, as in a run of one symbol
            at = _one_by_one(text, wanted, views, since, at)
            continue
        p = some[:size]
        if shared is not None:
            known = np.asarray(shared[at : at + size])
            ask = np.flatnonzero(known == UNKNOWN)
            if len(ask):
                shared[at + ask] = measured(text, queue[at + ask - 1].astype(np.int64), p[ask].astype(np.int64))
                known = np.asarray(shared[at : at + size])
        source = np.flatnonzero(p > 0)
        q = p[source] - 1
        take = kind[q] == wanted
        source, q = source[take], q[take]
        if shared is not None:
            so_far = np.minimum.accumulate(known)
        if len(q):
            c = text[q]
            order = np.argsort(c, kind="stable")
            c, q, source = c[order].astype(np.int64), q[order], source[order]
            new = np.append(True, c[1:] != c[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(c)))
            slots = head[c] + np.arange(len(c)) - np.repeat(first, many)
            queue[slots] = q
            if shared is not None:
                low = np.empty(len(c), np.uint8)
                low[first] = np.minimum(since[c[first]], so_far[source[first]])
                rest = np.flatnonzero(~new)
                low[rest] = _least(known, source[rest - 1], source[rest])
                # The first entry of a stretch follows one of another symbol, or what is put there beforehand.
                shared[slots] = np.where(slots == begin[c], 0, np.minimum(low.astype(np.int64) + 1, CAP))
                behind = np.append(np.minimum.accumulate(known[::-1])[::-1], CAP)
                np.minimum(since, so_far[-1], out=since)
                end = first + many - 1
                since[c[end]] = behind[source[end] + 1]
            head[c[first]] += many
        elif shared is not None:
            np.minimum(since, so_far[-1], out=since)
        at += size


def _one_by_one(text: np.ndarray, wanted: bool, views: list, since: np.ndarray, at: int) -> int:
    """As ``_pass`` for the next entries, one at a time; gives the place of the first that it leaves."""
    symbols, kind, queue, shared, head, begin = views
    for at in range(at, min(at + 4 * FEW, len(queue))):
        p = queue[at]
        if p < 0:
            return at
        if shared is not None:
            if shared[at] == UNKNOWN:
                shared[at] = int(measured(text, np.array([queue[at - 1]]), np.array([p]))[0])
            np.minimum(since, shared[at], out=since)
        if p and kind[p - 1] == wanted:
            c = symbols[p - 1]
            slot = head[c]
            queue[slot] = p - 1
            head[c] = slot + 1
            if shared is not None:
                shared[slot] = 0 if slot == begin[c] else min(int(since[c]) + 1, CAP)
                since[c] = CAP
    return min(at + 1, len(queue))


def _both(text: np.ndarray, kind: np.ndarray, symbols: int, points: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in the order that follows from ``points``, lowest points in order within each symbol, with the common prefix
    of each with the one before it if ``common`` has that of the points."""
    n = len(text)
    small = np.int32 if n < 2**31 else np.int64
    falls, rises = tally(text, symbols, ~kind), tally(text, symbols, kind)
    lows = np.bincount(text[points], minlength=symbols) if len(points) else np.zeros(symbols, np.int64)
    first = np.cumsum(falls + lows) - falls - lows
    queue = array(len(points) + int(falls.sum()), small, -1)
    shared = None if common is None else array(len(queue) + 1, np.uint8, 0)
    if len(points):
        c = text[points].astype(np.int64)
        slots = np.arange(len(points)) - (np.cumsum(lows) - lows)[c] + (first + falls)[c]
        queue[slots] = points
        if shared is not None:
            start = slots == (first + falls)[c]
            shared[slots] = np.where(start, np.where(falls[c] > 0, UNKNOWN, 0), common)
    _pass(text, kind, False, queue, shared, first.copy())
    # The second queue has all suffixes; it is read downwards, by views.
    full = array(n, small, -1)
    beside = None if common is None else array(n + 1, np.uint8, 0)
    begin = np.cumsum(falls + rises) - falls - rises
    for lo in range(0, symbols, STEP):
        some = np.flatnonzero(falls[lo : lo + STEP]) + lo
        if len(some):
            size = falls[some]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            to, of = np.repeat(begin[some], size) + step, np.repeat(first[some], size) + step
            full[to] = queue[of]
            if beside is not None:
                beside[to] = shared[of]
    if beside is not None:
        edge = (begin + falls)[(falls > 0) & (rises > 0)]
        beside[edge] = UNKNOWN
    del queue, shared
    _pass(text, kind, True, full[::-1], None if beside is None else beside[::-1], n - (begin + falls + rises))
    return full, beside


def _names(text: np.ndarray, points: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """A number for the substring from each lowest point to the next, in text order: equal for equal substrings, else in their order.

    Substrings are sorted as tuples of so many symbols as fit a word, and what is still tied by its next word. A
    substring that ends where another goes on is the larger one, for its last symbol rises and the other's falls.
    """
    n, count = len(text), len(points)
    size = np.append(points[1:] + 1, n) - points
    bits = int(symbols + 1).bit_length()
    fit = 63 // bits
    rank = array(count, np.int64, 0)
    left, at = np.arange(count), 0
    while len(left):
        word = np.zeros(len(left), np.int64)
        for i in range(at, at + fit):
            place = points[left] + i
            own = np.where(i < size[left], text[np.minimum(place, n - 1)].astype(np.int64) + 1, symbols + 1)
            if left[-1] == count - 1 and i >= size[-1]:
                own[-1] = 0  # behind the text's last substring comes its end, which is smallest
            word = (word << bits) | own
        order = np.lexsort((word, rank[left]))
        group, word = rank[left][order], word[order]
        fresh = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        place = np.arange(len(left))
        # A group's numbers begin with its own; the place of a word's first copy tells the others apart.
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        base = np.repeat(start, np.diff(np.append(start, len(left))))
        left = left[order]
        rank[left] = group + first - base
        many = np.diff(np.append(np.flatnonzero(fresh), len(left)))
        at += fit
        tied = np.repeat(many > 1, many) & (size[left] > at)
        left = np.sort(left[tied])
    found, names = np.unique(rank, return_inverse=True)
    return names, len(found)


def sorted_points(text: np.ndarray, kind: np.ndarray, symbols: int) -> np.ndarray:
    """Lowest points in the order of their suffixes."""
    points = lowest(kind)
    if len(points) < 2:
        return points
    names, many = _names(text, points, symbols)
    if many == len(points):
        order = array(many, np.int64)
        order[names] = points
        return order
    return points[sort(names, many)[0]]


def sort(text: np.ndarray, symbols: int, with_common: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """(order, common): positions of all suffixes of ``text``, whose values are below ``symbols``, in ascending order, and the common
    prefix of each with the one before it, up to CAP; its last place is beyond the last suffix."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(1, np.uint8) if with_common else None
    kind = rising(text)
    points = sorted_points(text, kind, symbols)
    common = None
    if with_common:
        common = np.zeros(len(points), np.uint8)
        for lo in range(1, len(points), STEP):
            hi = min(lo + STEP, len(points))
            common[lo:hi] = measured(text, points[lo - 1 : hi - 1], points[lo:hi])
    return _both(text, kind, symbols, points, common)
