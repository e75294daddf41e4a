"""Operator 11: periodic runs of words by uniting suffix classes in order of falling LCP.

Suffixes of a document that agree on L words form a class.  Classes are united from the
longest common prefix down (Kruskal over the neighbours of the suffix array).  A class
keeps its positions in order; two positions that become neighbours when classes meet have
a common prefix of exactly the current L, so at a distance d of at most L they start a
stretch of period d that ends d + L words on.  Those that can't be moved to the left are
the runs.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from corpusguard.llm.common import ddl, kept_columns
from corpusguard.llm.hashing import REMEMBERED, mix
from corpusguard.llm.word_blocks import Numbering

# A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# Positions of one stretch of an ordered set.
STRETCH = 512


class Positions:
    """An ordered set of positions in stretches, so that an insertion moves few of them."""

    def __init__(self, first: int):
        self.size = 1
        self.stretches = [[first]]
        self.lows = [first]

    def __iter__(self) -> Iterator[int]:
        for stretch in self.stretches:
            yield from stretch

    def around(self, position: int) -> tuple[int, int]:
        """The nearest member before and after a position that is no member; -1 where there is none."""
        k = bisect_left(self.lows, position) - 1
        if k < 0:
            return -1, self.lows[0]
        own = self.stretches[k]
        at = bisect_left(own, position)
        if at < len(own):
            return own[at - 1], own[at]
        return own[-1], self.lows[k + 1] if k + 1 < len(self.lows) else -1

    def add(self, position: int) -> None:
        k = max(0, bisect_left(self.lows, position) - 1)
        own = self.stretches[k]
        insort(own, position)
        self.lows[k] = own[0]
        self.size += 1
        if len(own) > 2 * STRETCH:
            self.stretches[k : k + 1] = [own[:STRETCH], own[STRETCH:]]
            self.lows[k : k + 1] = [own[0], own[STRETCH]]


def repeated(words: np.ndarray, length: int) -> bool:
    """Whether a stretch of `length` words may occur twice (equal hashes also count)."""
    if len(words) <= length:
        return False
    hashes, have = mix(words.astype(np.uint64) + np.uint64(1)), 1
    while 2 * have <= length:
        hashes = mix(hashes[:-have] + (hashes[have:] << np.uint64(1)) + np.uint64(have))
        have *= 2
    if have < length:
        rest = length - have
        hashes = mix(hashes[:-rest] + (hashes[rest:] << np.uint64(1)) + np.uint64(rest))
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, by prefix doubling, and the common prefix of each suffix with the next one."""
    count = len(words)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    while ranks[-1].max(initial=0) < count - 1:
        step = 1 << (len(ranks) - 1)
        last = ranks[-1].astype(np.int64)
        after = np.zeros(count, dtype=np.int64)
        after[: max(0, count - step)] = last[step:] + 1
        ranks.append(np.unique(last * (count + 1) + after, return_inverse=True)[1].astype(np.int32))
    order = np.empty(count, dtype=np.int64)
    order[ranks[-1]] = np.arange(count)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, count - 1), dtype=np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        # Ranks of suffixes that end early differ, so equal ranks mean that many equal words.
        inside = np.maximum(left, right) + (1 << level) <= count
        same = np.zeros(len(left), dtype=bool)
        same[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
        moved = same.astype(np.int64) << level
        left, right, common = left + moved, right + moved, common + moved
    return order, common


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period.

    A run is a stretch of smallest period q, of at least `least_words` words and
    `least_periods` (2 or more) times q, that no neighbouring word extends.  Common
    prefixes too short for any run are not united.
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods may have no ordered neighbours")
    # A run of period q has a common prefix of its length less q.
    shortest = max(1, -(-least_words * (least_periods - 1) // least_periods))
    shortest = min(shortest, least_words - 1) if least_words > 1 else 1
    if len(words) < least_words or not repeated(words, shortest):
        return []
    order, common = neighbours(words)
    near = np.flatnonzero(common >= shortest)
    near = near[np.argsort(-common[near], kind="stable")]
    plain = words.tolist()
    owner: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(position: int) -> int:
        top = position
        while (up := owner.setdefault(top, top)) != top:
            top = up
        while owner[position] != top:
            owner[position], position = top, owner[position]
        if top not in sets:
            sets[top] = Positions(top)
        return top

    found: list[tuple[int, int, int]] = []

    def seed(first: int, second: int, level: int) -> None:
        period = second - first
        length = period + level
        if level < (least_periods - 1) * period or length < least_words:
            return
        if first == 0 or plain[first - 1] != plain[second - 1]:
            found.append((first, length, period))

    for one, two, level in zip(order[near].tolist(), order[near + 1].tolist(), common[near].tolist()):
        large, small = root(one), root(two)
        if sets[large].size < sets[small].size:
            large, small = small, large
        own, members = sets[large], list(sets.pop(small))
        owner[small] = large
        # Neighbours that were together before met at a longer prefix; only mixed pairs are new.
        met = [own.around(position) for position in members]
        for k, (position, (before, after)) in enumerate(zip(members, met)):
            if before >= 0 and (k == 0 or members[k - 1] < before):
                seed(before, position, level)
            if after >= 0 and (k + 1 == len(members) or after < members[k + 1]):
                seed(position, after, level)
        for position in members:
            own.add(position)
    return sorted(found, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(
    docs: DataFrame,
    text: str = "text",
    keep: list[Column] | None = None,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    digest: bool = False,
) -> DataFrame:
    """`keep` columns (default: all but the text) with runs (start, length, period), the strongest of them, and collapsed.

    n_runs, start, length, period and exponent_milli describe the run of most periods (null
    without one); collapsed is the text of the words that no run repeats: a run leaves its
    first period.  With `digest`, runs_sha256 and collapsed_sha256 take the places of runs
    and collapsed.  Null, empty and wordless texts have no runs and collapse to the empty
    text.  Ties and repeated rows are answered row by row; a text of any length is one
    sequence, in memory in proportion to it; an empty table gives an empty result.  Columns
    of docs named like a result are replaced.
    """
    results = ["n_runs", "start", "length", "period", "exponent_milli"]
    results += ["runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"]
    kept = kept_columns(docs, text, keep, (text, *results))
    names = [c for c in kept.columns if c != "__text"]
    pair = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = [pa.int64()] * 5 + ([pa.string()] * 2 if digest else [pair, pa.string()])
    numbering = Numbering()

    def answer(body: str) -> tuple:
        words = body.encode().split()
        if len(numbering) > REMEMBERED:
            numbering.clear()
        numbers = np.fromiter(map(numbering.__getitem__, words), dtype=np.int64, count=len(words))
        runs = runs_of(numbers, least_words, least_periods)
        if runs:
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            for start, length, period in runs:
                marks[start + period] += 1
                marks[start + length] -= 1
            words = [word for word, covered in zip(words, np.cumsum(marks).tolist()) if not covered]
        best = strongest(runs)
        described = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        collapsed = b" ".join(words)
        if not digest:
            rows = [dict(zip(("start", "length", "period"), run)) for run in runs]
            return *described, rows, collapsed.decode()
        lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        return *described, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(value.as_py() or "") for value in batch.column("__text")]
            columns = list(zip(*found)) or [()] * len(results)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(c, t) for c, t in zip(columns, types)], [*names, *results]
            )

    kinds = ["long"] * 5 + (["string"] * 2 if digest else ["array<struct<start:bigint,length:bigint,period:bigint>>", "string"])
    return kept.mapInArrow(run, ddl(kept) + ", ".join(f"{name} {kind}" for name, kind in zip(results, kinds)))
