"""Runs of repeated words (maximal repetitions) by the branching-tandem test on an enhanced suffix array.

The words of some texts become one sequence of numbers, every text with an alphabet and an end mark of its own, so no
repeat crosses texts. Prefix doubling gives the suffix array, its inverse (ISA) and, kept per level, the rank of every
word string of length 2**k. Two equal ranks say that two strings of that length are equal, which gives the LCP array and
the extensions below in a step per level.

A pass over the LCP array names its intervals, each with a depth, and their child intervals. For every suffix ``i`` of
all but the largest child, ``ISA[i + depth]`` and ``ISA[i - depth]`` are looked up: where one lies in the interval and
the next words differ, a square ends there that cannot be moved to the right. Squares are rotated to the left, by powers
of two, as long as the words agree; squares that then cover the same stretch are one run, whose period is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Texts are searched together up to this many words; a longer text is searched alone, and whole.
TOGETHER = 60_000
#: Suffixes looked up at once.
CHUNK = 2_000_000

_RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _ties(first: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, from the mask of first members of sorted groups."""
    return ~(first & np.r_[first[1:], True])


def suffix_ranks(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and, for k = 0, 1, ..., the ranks of the strings of length 2**k; the last ranks are the inverse array.

    Only suffixes that are still tied are sorted again. ``codes`` must end each text with a code found nowhere else.
    """
    n = len(codes)
    sa = np.argsort(codes, kind="stable")
    first = np.r_[True, codes[sa[1:]] != codes[sa[:-1]]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, slots, h = [rank.astype(np.int32)], np.flatnonzero(_ties(first)), 1
    while len(slots):
        p = sa[slots]
        key = rank[p] * n + rank[p + h]  # tied strings hold no end mark, so p + h is inside
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[slots] = p
        first = np.r_[True, key[1:] != key[:-1]]
        rank[p] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        levels.append(rank.astype(np.int32))
        slots = slots[_ties(first)]
        h *= 2
    return sa, levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``."""
    found = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        found += (levels[k][a + found] == levels[k][b + found]).astype(np.int64) << k
    return found


def _rotated(levels: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """First word of the stretch with this period that holds the square at ``start``."""
    at = start.copy()
    for k in range(len(levels) - 2, -1, -1):
        back = at - (1 << k)
        at = np.where((back >= 0) & (levels[k][np.maximum(back, 0)] == levels[k][np.maximum(back, 0) + period]), back, at)
    return at


def _intervals(lcp: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LCP intervals as (left, right, depth), and each place where one is divided with the number of its interval."""
    left, right, depth, place, owner, stack = [], [], [], [], [], []
    for k, d in enumerate(lcp):
        start = k - 1
        while stack and depth[stack[-1]] > d:
            v = stack.pop()
            right[v], start = k - 1, left[v]
        if d > 0:
            if not stack or depth[stack[-1]] < d:
                stack.append(len(left))
                left.append(start)
                right.append(0)
                depth.append(d)
            place.append(k)
            owner.append(stack[-1])
    return tuple(np.array(x, np.int64) for x in (left, right, depth, place, owner))


def _smaller_children(left: np.ndarray, right: np.ndarray, place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, number of suffixes, interval) of all children but the largest one of each interval."""
    order = np.argsort(owner, kind="stable")
    place, owner = place[order], owner[order]
    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    after = np.r_[place[1:], 0]
    after[np.r_[head[1:] - 1, len(place) - 1]] = right[owner[head]] + 1
    begin = np.r_[left[owner[head]], place]
    size = np.r_[place[head] - left[owner[head]], after - place]
    of = np.r_[owner[head], owner]
    order = np.lexsort((-size, of))
    keep = order[np.r_[False, of[order][1:] == of[order][:-1]]]
    return begin[keep], size[keep], of[keep]


def find_runs(codes: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, end, period) of all runs of at least ``max(least, 2 * period)`` codes, sorted; ends are exclusive."""
    none = np.zeros((0, 3), np.int64)
    if len(codes) < 2:
        return none
    sa, levels = suffix_ranks(codes)
    isa, word, n = levels[-1], levels[0], len(codes)
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = _common(levels, sa[:-1], sa[1:])
    left, right, depth, place, owner = _intervals(lcp.tolist())
    if not len(place):
        return none
    begin, size, of = _smaller_children(left, right, place, owner)
    squares = []
    upto = np.cumsum(size)
    cuts = np.unique(np.r_[0, np.searchsorted(upto, np.arange(CHUNK, upto[-1] + CHUNK, CHUNK)), len(size)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s = size[a:b]
        v = np.repeat(of[a:b], s)
        i = sa[np.repeat(begin[a:b] - np.r_[0, np.cumsum(s)[:-1]], s) + np.arange(s.sum())]
        d, lo, hi = depth[v], left[v], right[v]
        for at in (i, i - d):  # i as the first half of a square, and as its second half
            ok = at >= 0
            other = np.where(ok, at + d if at is i else at, 0)
            ok &= (isa[other] >= lo) & (isa[other] <= hi)
            x, y = at[ok], d[ok]
            branching = word[x + y] != word[x + 2 * y]
            squares.append(np.stack([x[branching], y[branching]], axis=1))
    start, period = np.concatenate(squares).T
    end = start + 2 * period
    start = _rotated(levels, start, period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    keep &= end - start >= np.maximum(least, 2 * period)
    return np.stack([start, end, period], axis=1)[keep]


def _together(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    group, n = [], 0
    for t in texts:
        group.append(t.split() if t else [])
        n += len(group[-1]) + 1
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def search(group: list[list[bytes]], least: int) -> list[tuple[np.ndarray, bytes]]:
    """For each list of words its runs, as (start, length, period), and the text without the repeats."""
    sizes = np.array([len(w) + 1 for w in group])
    first = np.r_[0, np.cumsum(sizes)]
    number = _Numbers()
    codes = np.repeat(np.arange(len(group), dtype=np.int64) << 32, sizes)
    for at, words in zip(first, group, strict=False):
        codes[at : at + len(words)] += np.fromiter((number[w] for w in words), np.int64, len(words))
    codes[first[1:] - 1] += (1 << 32) - 1
    runs = find_runs(codes, least)
    at = np.searchsorted(runs[:, 0], first)
    out = []
    for k, words in enumerate(group):
        own = runs[at[k] : at[k + 1]] - [first[k], first[k], 0]
        if len(own):
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, own[:, 0] + own[:, 2], 1)
            np.add.at(depth, own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
            own = np.stack([own[:, 0], own[:, 1] - own[:, 0], own[:, 2]], axis=1)
        out.append((own, b" ".join(words)))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """``docs`` plus ``runs`` and ``collapsed``.

    Words are runs of code points other than ASCII white space. ``runs`` holds every run (start, length, period), counted
    in words from 0, in order of start, then period; ``collapsed`` is the text of the words that no run contains behind its
    first period, joined by one space. A null or empty text, or one without words, has no runs and an empty
    ``collapsed``. Nulls elsewhere and repeated rows pass through, each row being searched for itself; columns named
    ``runs`` or ``collapsed`` are replaced; an empty table gives an empty result. Texts are searched whole, where they
    lie, without a shuffle: a task holds one batch, and 4 bytes a word for each power of two up to the longest repeat.
    """
    own = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]
    names = [f.name for f in own]
    schema = StructType([*own, StructField("runs", ArrayType(_RUN)), StructField("collapsed", StringType())])
    struct = pa.struct([(n, pa.int64()) for n in _RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for group in _together(batch.column(text).cast(pa.binary()).to_pylist()) for x in search(group, least)]
            flat = np.concatenate([r for r, _ in found]) if found else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *(len(r) for r, _ in found)])
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(struct)))
            collapsed = pa.array([c for _, c in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), runs, collapsed], names=[*names, "runs", "collapsed"])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)
