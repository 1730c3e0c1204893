"""Runs of periodically repeated words by online dyadic square catching.

A square is a stretch of words followed by itself; the words of a run of period
q are squares of q words all along it. Words are appended to a `Catcher`, which
keeps one catcher for every completed block of 2^k words that starts at a
multiple of 2^k. The first half of a square of period q holds such a block of
2^k words with 2^(k+1) <= q < 2^(k+2) (with one word and q < 4 on the lowest
level), and the block comes again q words later. So the catchers of a level
that an appended word can complete a repetition for are two (three on the
lowest level): those whose blocks began between 2^(k+1) and 2^(k+2) words before
the window of 2^k words that ends there. Windows have names, each made of the
names of its two halves, and a catcher compares its block's name with that of
the new window.

Repetitions of one period at neighbouring blocks chain up; a chain's ends lie
less than a block away from where its run ends, so that word by word comparisons
forwards and backwards settle them. What is found again at multiples of a period
has the same ends and merges into the run of the least period. Names are 64-bit
mixes; every run is held against the words themselves, and a period for which
names of unequal windows were equal is compared word by word.

Numpy advances all catchers by all words of an append, and a task appends the
texts of a batch one after another with a word between them that equals none;
the outcome is the same word by word. Work is some 2n comparisons for each of
log n levels, whatever repeats; memory follows one batch and its longest text.

Cases: null and blank texts have no words, hence no runs; repeated rows and ids
get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import split_words

# Words that one catcher is given before its runs are taken, unless a text is longer.
BATCH_WORDS = 1 << 18
# Comparisons that are made at a time.
CHUNK = 1 << 22

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of windows from the names of their halves."""
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + _mixed(right + np.uint64(0x632BE59BD9B4E019)))


class Catcher:
    """Runs of the words appended so far; words are non-negative numbers.

    `longest` bounds the periods to half of it: no stretch is longer.
    """

    def __init__(self, longest: int | None = None):
        self.longest = longest
        self.words = np.zeros(0, np.int64)
        # Per level: the names of all its windows, and chains (period, first block, last block).
        self.names: list[np.ndarray] = []
        self.chains: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        """Advance every catcher by each of these words."""
        self.words = np.concatenate([self.words, words])
        n = len(self.words)
        most = n if self.longest is None else min(n, self.longest)
        level = 0
        while self._least(level) <= most // 2:
            if level == len(self.names):
                self.names.append(np.zeros(0, np.uint64))
                self.chains.append(np.zeros((0, 3), np.int64))
            known = len(self.names[level])
            if level == 0:
                new = _mixed(self.words[known:].astype(np.uint64))
            else:
                half, below = 1 << (level - 1), self.names[level - 1]
                new = _joined(below[known : len(below) - half], below[known + half :])
            self.names[level] = np.concatenate([self.names[level], new])
            for a in range(known, len(self.names[level]), CHUNK):
                self._catch(level, a, min(a + CHUNK, len(self.names[level])))
            level += 1

    @staticmethod
    def _least(level: int) -> int:
        """Least period of a level; the next level's is where it ends."""
        return 1 if level == 0 else 2 << level

    def _catch(self, level: int, start: int, stop: int) -> None:
        """Compare the windows that begin at [start, stop) with the live catchers' blocks."""
        names, size = self.names[level], 1 << level
        least, windows = self._least(level), np.arange(start, stop)
        newest = (windows - least) // size
        hits = []
        for back in range(3 if level == 0 else 2):
            block = newest - back
            live = block >= 0
            same = names[windows[live]] == names[block[live] * size]
            found, at = block[live][same], windows[live][same]
            hits.append(np.column_stack([at - found * size, found, found]))
        new = np.concatenate(hits)
        if len(new):
            self.chains[level] = _chained(np.concatenate([self.chains[level], new]))

    def runs(self, least: int = 2) -> np.ndarray:
        """start, length, period of all runs of at least `least` words, by start and period."""
        rows = np.zeros((0, 3), np.int64)
        for level in range(len(self.chains)):
            rows = np.concatenate([rows, self._extended(level, rows)])
        rows = rows[rows[:, 1] >= least]
        # The same stretch at multiples of a period: the least one names it.
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)] if len(rows) else np.zeros(0, bool)
        rows = rows[first]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]

    def _extended(self, level: int, known: np.ndarray) -> np.ndarray:
        """The stretches around the chains of a level that hold a square.

        What lies in a `known` stretch whose period divides the chain's is that stretch again.
        """
        size, words = 1 << level, self.words
        period, first, last = self.chains[level].T
        start, stop = first * size, (last + 1) * size + period
        # Less than a block can be won at either end.
        near = stop - start + 2 * (size - 1) >= 2 * period
        for s, n, q in known[known[:, 1] >= self._least(level) + size].tolist():
            near &= (start < s) | (stop > s + n) | (period % q != 0)
        period, start, stop = period[near], start[near].copy(), stop[near].copy()
        for step, ends in ((-1, start), (1, stop)):
            moving = np.arange(len(ends))
            while len(moving):
                at = ends[moving] - 1 if step < 0 else ends[moving]
                other = at + period[moving] if step < 0 else at - period[moving]
                inside = (at >= 0) & (at < len(words)) & (other < len(words))
                moving, at, other = moving[inside], at[inside], other[inside]
                moving = moving[words[at] == words[other]]
                ends[moving] += step
        full = stop - start >= 2 * period
        rows = np.column_stack([start, stop - start, period])[full]
        wrong = {q for s, n, q in rows.tolist() if (words[s : s + n - q] != words[s + q : s + n]).any()}
        if not wrong:
            return rows
        right = rows[~np.isin(rows[:, 2], list(wrong))]
        return np.concatenate([right, *(_of_period(words, q) for q in sorted(wrong))])


def _chained(chains: np.ndarray) -> np.ndarray:
    """Chains of one period that meet, in one."""
    chains = chains[np.lexsort((chains[:, 1], chains[:, 0]))]
    apart = (chains[1:, 0] != chains[:-1, 0]) | (chains[1:, 1] > chains[:-1, 2] + 1)
    firsts = np.flatnonzero(np.r_[True, apart])
    lasts = np.r_[firsts[1:], len(chains)] - 1
    return np.column_stack([chains[firsts, :2], chains[lasts, 2]])


def _of_period(words: np.ndarray, q: int) -> np.ndarray:
    """start, length, period of all stretches of one period, by comparing each word."""
    same = np.r_[False, words[q:] == words[:-q], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edges[::2], edges[1::2] + q
    rows = np.column_stack([start, stop - start, np.full(len(start), q)])
    return rows[rows[:, 1] >= 2 * q]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows [a, b) whose texts go to one catcher."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BATCH_WORDS, side="right")) - 1)
        yield a, b
        a = b


def runs_of_texts(numbers: np.ndarray, offsets: np.ndarray, least: int) -> list[np.ndarray]:
    """Runs of each text [offsets[i], offsets[i + 1]) of `numbers`."""
    out: list[np.ndarray] = []
    for a, b in _pieces(offsets):
        sizes = np.diff(offsets[a : b + 1])
        # A word of its own stands before each text but the first.
        starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
        stream = np.arange(int(sizes.sum()) + b - a - 1, dtype=np.int64) + (1 << 40)
        places = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(np.r_[0, sizes[:-1]]), sizes)
        stream[places] = numbers[offsets[a] : offsets[b]]
        catcher = Catcher(int(sizes.max(initial=0)))
        catcher.append(stream)
        runs = catcher.runs(least)
        cuts = np.searchsorted(runs[:, 0], starts[1:])
        for start, part in zip(starts, np.split(runs, cuts), strict=True):
            out.append(part - np.array([start, 0, 0]))
    return out


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets, np.int64)
            offsets = offsets - offsets[0]
            words = lists.flatten()
            numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs_of_texts(numbers, offsets, least)
            rows, texts = [], []
            for i, runs in enumerate(found):
                own = words[int(offsets[i]) : int(offsets[i + 1])]
                if len(runs):
                    own = own.filter(pa.array(~dropped_words(len(own), runs)))
                rows.append([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()])
                texts.append(" ".join(own.to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, struct), pa.array(texts, pa.string())], ["id", "runs", "collapsed"]
            )

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", words: Column | None = None, least: int = 12
) -> DataFrame:
    """id_col, `runs` (by start, then period) and the text without repetitions, of every row.

    A run is a maximal stretch of words with a smallest period of at most half its
    length; those of `least` words or more count. `words` are the words of a row, by
    default those of its text. A word that a run holds after its first period goes
    from `collapsed`, where one space stands between words.
    """
    given = split_words(F.col("text")) if words is None else words
    rows = docs.select(F.col(id_col).cast("long").alias("id"), given.alias("words"))
    found = rows.mapInArrow(_find(least), f"id long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_col)
