"""Maximal periodic stretches (runs) of words, by uniting suffix classes in order of decreasing LCP.

The suffixes of a document's words are sorted. Going down from the longest common prefix, neighbours in
that order are united (Kruskal's algorithm on a path), so at level l the classes hold the positions that share
their next l words. Each class keeps its positions in order. Two positions at distance d that become
neighbours in a class at level l >= d begin a stretch of d + l words with period d. d is its smallest period: with a smaller
one, a position between them would share more than l words and part them. The stretch's first
position and the one a period later are neighbours at just that level, so every run is seeded; the seeds that
start further right are those whose words to the left agree too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, text_or_empty

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
WORDS_AT_ONCE = 200_000  # documents are sorted together up to so many words; a longer one is sorted by itself


def repeated_grams(codes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each position on are likely (equal 64-bit hashes) found again in the same document."""
    n = len(codes) - size + 1
    again = np.zeros(len(codes), dtype=bool)
    if n <= 1:
        return again
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = owner[:n].astype(np.uint64)
    for k in range(size):
        h = (h ^ mixed[k:k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    equal &= owner[size - 1:][order[1:]] == owner[order[1:]]  # a gram does not reach into the next document
    equal &= owner[size - 1:][order[:-1]] == owner[order[:-1]]
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    return again


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions sorted by their suffixes: ranks by one word, then by twice as many words each time, where only
    positions that still tie are sorted again."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    value = codes[order]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1

    def group(at: np.ndarray, new: np.ndarray, first: np.ndarray) -> None:
        start = np.maximum.accumulate(np.where(new, first, 0))
        rank[at] = start

    group(order, np.concatenate(([True], value[1:] != value[:-1])), np.arange(n))
    k = 1
    while True:
        held = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = held[1:] == held[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places) or k > n:
            return order
        at = order[places]
        nxt = rank[np.minimum(at + k, n)]
        inner = np.lexsort((nxt, held[places]))
        at, nxt, held = at[inner], nxt[inner], held[places][inner]
        order[places] = at
        new = np.concatenate(([True], (held[1:] != held[:-1]) | (nxt[1:] != nxt[:-1])))
        group(at, new, places)
        k *= 2


def neighbours(codes: np.ndarray, again: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(lcp, position, position) for neighbours in suffix order that share at least ``size`` words. A position's
    common prefix is at least its left neighbour's less one word, so words are compared on from there."""
    order, n = suffix_order(codes), len(codes)
    both = again[order[1:]] & again[order[:-1]]
    left, right = order[:-1][both], order[1:][both]
    by_place = np.argsort(right)
    codes = codes.tolist()
    out, long, last = [], 0, -2
    for i, j in zip(right[by_place].tolist(), left[by_place].tolist()):
        long = long - 1 if i == last + 1 and long else 0
        end = n - max(i, j)
        while long < end and codes[i + long] == codes[j + long]:
            long += 1
        if long >= size:
            out.append((long, i, j))
        last = i
    return out


def seeds(edges: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(position, distance, lcp) of positions that become neighbours in their class at a level not below their
    distance. ``edges`` are worked through by decreasing LCP; those of one level are all united before
    neighbours are looked at."""
    top: dict[int, int] = {}
    held: dict[int, list[int]] = {}
    follows: dict[int, int] = {}

    def root(x: int) -> int:
        if x not in top:
            top[x], held[x], follows[x] = x, [x], -1
            return x
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    edges = sorted(edges, reverse=True)
    at = 0
    while at < len(edges):
        level, changed = edges[at][0], {}
        while at < len(edges) and edges[at][0] == level:
            a, b = root(edges[at][1]), root(edges[at][2])
            at += 1
            if a == b:
                continue
            if len(held[a]) < len(held[b]):
                a, b = b, a
            big = held[a]
            for x in held.pop(b):
                p = bisect_left(big, x)
                left, right = (big[p - 1] if p else -1), (big[p] if p < len(big) else -1)
                big.insert(p, x)
                changed.setdefault(x, follows[x])
                follows[x] = right
                if left >= 0:
                    changed.setdefault(left, follows[left])
                    follows[left] = x
            top[b] = a
        for x, old in changed.items():
            y = follows[x]
            if y >= 0 and y != old and y - x <= level:
                yield x, y - x, level


def runs_of(codes: np.ndarray, again: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs (start, length, period), by start, then period. ``again`` marks all positions from which at least
    ``(least + 1) // 2`` words are found again: a run of period d has l = length - d >= d words in common with itself a
    period on, so l >= least / 2."""
    edges = neighbours(codes, again, (least + 1) // 2)
    return sorted((i, d + level, d) for i, d, level in seeds(edges) if d + level >= least and (i == 0 or codes[i - 1] != codes[i + d - 1]))


def _together(words: list[list[bytes]]) -> Iterator[list[int]]:
    """Numbers of the documents that are sorted together."""
    now, n = [], 0
    for k, w in enumerate(words):
        if now and n + len(w) > WORDS_AT_ONCE:
            yield now
            now, n = [], 0
        now.append(k)
        n += len(w)
    if now:
        yield now


def runs_of_all(words: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each document. Documents are sorted together, with words numbered apart for each and one
    more number at its end; those in which no ``(least + 1) // 2`` words in a row are found again have no run."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for some in _together(words):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        each = [np.fromiter(map(numbers.__getitem__, words[k]), np.int64, len(words[k])) for k in some]
        ends = np.cumsum([len(c) for c in each])
        again = np.split(repeated_grams(np.concatenate(each), np.repeat(np.arange(len(some)), [len(c) for c in each]), (least + 1) // 2), ends[:-1])
        held = [k for k, a in enumerate(again) if a.any()]
        if not held:
            continue
        apart, wide = [], len(numbers) + 1
        for at, k in enumerate(held):
            apart += [each[k] + at * wide, np.array([at * wide + wide - 1])]
        marks = np.concatenate([m for k in held for m in (again[k], np.array([False]))])
        starts = np.concatenate(([0], np.cumsum([len(each[k]) + 1 for k in held])))
        found = runs_of(np.concatenate(apart), marks, least)
        for (start, length, period), at in zip(found, (np.searchsorted(starts, [r[0] for r in found], "right") - 1).tolist()):
            out[some[held[at]]].append((start - int(starts[at]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that stand in a run after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def with_runs(docs: DataFrame, least: int = 12, text_col: str = "text", runs_out: str = "runs", collapsed_out: str = "collapsed") -> DataFrame:
    """``docs`` with ``runs_out``: the runs of the text's words (start, length, period; by start, then period),
    and ``collapsed_out``: the text without the words that a run repeats, joined by blanks.

    A run has smallest period q, at least ``max(least, 2 q)`` words, and no neighbouring word continues its
    period. Words are runs without U+0020, U+0009..U+000D. A null or empty text has no words, no runs and an empty
    collapsed text. All other columns stay as they are, whatever their names but the two new ones, which
    replace columns of that name; the text stays null where it was. Rows are judged one by one, so repeated rows and
    ties change nothing. An empty table gives no rows. Whole texts are read, however long; memory follows the longest one.
    """
    docs = docs.drop(runs_out, collapsed_out)
    whole = fresh(docs, "_whole")
    schema = T.StructType([*docs.schema.fields, T.StructField(runs_out, RUNS), T.StructField(collapsed_out, T.StringType())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.int64(), pa.int64(), pa.int64()]
        for batch in slices(batches):
            words = [t.encode("utf-8", "replace").split() for t in batch.column(whole).to_pylist()]
            found = runs_of_all(words, least)
            short = [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, found)]
            flat = [r for rs in found for r in rs]
            parts = [pa.array([r[k] for r in flat], t) for k, t in enumerate(fields)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(short, pa.string())], names=[*names, runs_out, collapsed_out])

    return docs.withColumn(whole, text_or_empty(text_col)).mapInArrow(run, schema)
