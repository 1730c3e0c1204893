"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of token ids, its documents one after the other. Every
window of `size` tokens credits each source its share; whole tokens are sent,
fractions stay as deficits for the next window, and what a window still lacks
goes to the largest deficits. The round repeats after `period` windows, so what
a source has sent before any window has a closed form: a task cuts its documents
knowing only where they stand in their queue, and deficits carry across windows
and partitions without any pass over the data. When a source cannot fill its
part of a window any more, its rest (less than that part) goes to the tail and
the others share the windows from there on. The tail's rests are packed one
after the other into full windows; only the last window may be padded.

Documents are tokenized once; ids are written to the shared folder and read
again for cutting. Places in a queue are sums over blocks (tasks of the first
pass) and within them, so a source that holds most rows is no hot key. The
driver holds one number for each source and period.

Cases: a null text is empty (its end id alone); a null source is a queue of its
own; repeated ids and rows are each packed; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved
from .tokens import word_tokens

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
# Texts tokenized at a time.
ROWS = 256


@dataclass(frozen=True)
class Phase:
    """Windows over which the same sources are active.

    By source: `sent[w]` tokens before window w of the round (period + 1 values)
    and `place[w]` the source's first column in that window; `begin` is where in
    the queue the phase starts.
    """

    first: int
    windows: int
    sent: dict[str, np.ndarray]
    place: dict[str, np.ndarray]
    begin: dict[str, int]


@dataclass(frozen=True)
class Schedule:
    size: int
    period: int
    phases: list[Phase]
    tail_window: int
    # Source to (queue position where its rest begins, place of the rest in the tail).
    tail: dict[str, tuple[int, int]]


def _round(credit: dict[str, int], size: int, period: int) -> tuple[dict, dict]:
    """The windows of one round: `credit` is each source's tokens in a whole round."""
    names = list(credit)
    deficit = dict.fromkeys(names, 0)
    sent = {s: [0] for s in names}
    place: dict[str, list[int]] = {s: [] for s in names}
    for _ in range(period):
        for s in names:
            deficit[s] += credit[s]
        part = {s: max(deficit[s] // period, 0) for s in names}
        lack = size - sum(part.values())
        order = sorted(names, key=lambda s: deficit[s] - part[s] * period, reverse=lack > 0)
        while lack:
            step = 1 if lack > 0 else -1
            for s in order:
                if lack and part[s] + step >= 0:
                    part[s] += step
                    lack -= step
        column = 0
        for s in names:
            deficit[s] -= part[s] * period
            sent[s].append(sent[s][-1] + part[s])
            place[s].append(column)
            column += part[s]
    return {s: np.array(v) for s, v in sent.items()}, {s: np.array(v) for s, v in place.items()}


def _before(sent: np.ndarray, window: int, period: int) -> int:
    return int(window // period * sent[-1] + sent[window % period])


def _windows_fed(sent: np.ndarray, tokens: int, period: int) -> int:
    """How many windows a source with so many tokens can feed."""
    if sent[-1] == 0:
        return 1 << 62
    rounds, rest = divmod(tokens, int(sent[-1]))
    return rounds * period + int(np.searchsorted(sent, rest, side="right")) - 1


def make_schedule(
    totals: dict[str, int],
    weights: dict[str, float] | None = None,
    size: int = 2048,
    period: int = 64,
) -> Schedule:
    """Plan windows for queues of `totals` tokens; without `weights` by their own shares."""
    weights = weights or {s: float(n) for s, n in totals.items()}
    left = {s: totals[s] for s in sorted(totals)}
    active = [s for s in left if weights.get(s, 0) > 0 and left[s] > 0]
    phases: list[Phase] = []
    done = 0
    while active:
        whole = sum(weights[s] for s in active)
        exact = {s: size * period * weights[s] / whole for s in active}
        credit = {s: int(v) for s, v in exact.items()}
        for s in sorted(active, key=lambda s: credit[s] - exact[s]):
            if sum(credit.values()) < size * period:
                credit[s] += 1
        sent, place = _round(credit, size, period)
        fed = {s: _windows_fed(sent[s], left[s], period) for s in active}
        windows = min(fed.values())
        if windows:
            begin = {s: totals[s] - left[s] for s in active}
            phases.append(Phase(done, windows, sent, place, begin))
            for s in active:
                left[s] -= _before(sent[s], windows, period)
            done += windows
        active = [s for s in active if fed[s] > windows and left[s] > 0]
    tail, at = {}, 0
    for s in left:
        tail[s] = (totals[s] - left[s], at)
        at += left[s]
    return Schedule(size, period, phases, done, tail)


def pieces_of(plan: Schedule, source: str, position: int, n: int) -> tuple[np.ndarray, ...]:
    """(start, length, sequence_id, offset) of the n tokens at `position` of a queue."""
    starts, sequences, offsets = [], [], []
    stop = position + n
    for phase in plan.phases:
        if source not in phase.sent:
            continue
        sent, begin = phase.sent[source], phase.begin[source]
        end = begin + _before(sent, phase.windows, plan.period)
        lo, hi = max(position, begin) - begin, min(stop, end) - begin
        if lo >= hi:
            continue
        per_round = int(sent[-1])
        first = lo // per_round * plan.period + int(np.searchsorted(sent, lo % per_round, "right")) - 1
        last = (hi - 1) // per_round * plan.period
        last += int(np.searchsorted(sent, (hi - 1) % per_round, "right")) - 1
        w = np.arange(first, last + 1)
        before = w // plan.period * per_round + sent[w % plan.period]
        size = sent[w % plan.period + 1] - sent[w % plan.period]
        w, before = w[size > 0], before[size > 0]
        cut = np.maximum(before, lo)
        starts.append(cut + begin - position)
        sequences.append(w + phase.first)
        offsets.append(phase.place[source][w % plan.period] + cut - before)
    begin, at = plan.tail[source]
    if stop > begin:
        lo = at + max(position - begin, 0)
        hi = at + stop - begin
        cuts = np.unique(np.r_[lo, np.arange(-(-lo // plan.size), -(-hi // plan.size)) * plan.size])
        starts.append(cuts - at + begin - position)
        sequences.append(plan.tail_window + cuts // plan.size)
        offsets.append(cuts % plan.size)
    start = np.concatenate(starts)
    return start, np.diff(np.r_[start, n]), np.concatenate(sequences), np.concatenate(offsets)


def _tokenize(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        reached: dict[str, int] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                encoded = word_tokens(path).encode(batch.column(2).to_pylist())
                starts, sizes = [], []
                for source, ids in zip(batch.column(1).to_pylist(), encoded, strict=True):
                    starts.append(reached.get(source, 0))
                    sizes.append(len(ids) // 4 + 1)
                    reached[source] = starts[-1] + sizes[-1]
                # Ids below 2**16 are kept in two bytes.
                small = [np.frombuffer(x + end, "<u4") for x in encoded]
                data = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in small]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([block] * len(sizes), pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    ["doc_id", "queue", "block", "place", "n", "ids"],
                )

    return run


def _cut(plan: Schedule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:4]]
            parts: list[list] = [[] for _ in range(7)]
            for doc, queue, position, n, data in zip(*columns, batch.column(4), strict=True):
                data = data.as_py()
                ids = np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2").astype("<u4")
                start, length, sequence, offset = pieces_of(plan, queue, position, n)
                view = memoryview(ids).cast("B")
                crc = [
                    zlib.crc32(view[4 * a : 4 * (a + k)])
                    for a, k in zip(start.tolist(), length.tolist(), strict=True)
                ]
                parts[0] += [doc] * len(start)
                parts[3] += crc
                parts[4].append(np.full(len(start), n))
                for k, column in ((1, start), (2, length), (5, sequence), (6, offset)):
                    parts[k].append(column)
            arrays = [
                pa.array(p if k in (0, 3) else np.concatenate(p) if p else [], pa.int64())
                for k, p in enumerate(parts)
            ]
            yield pa.RecordBatch.from_arrays(
                arrays,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack_mixture(
    docs: DataFrame,
    tokenizer_path: str,
    weights: dict[str, float] | None = None,
    size: int = 2048,
    period: int = 64,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of every document in windows of `size` tokens.

    `weights` are the target proportions by source; a source without one, and
    what is left when the others are used up, goes to the tail. Without weights
    the sources' own token counts are the target.
    """
    queue = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("source:"), "source"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text")
    )
    tokenized = saved(
        rows.mapInArrow(
            _tokenize(tokenizer_path, end_id),
            "doc_id long, queue string, block long, place long, n long, ids binary",
        ),
        "tokens",
    )
    blocks = saved(tokenized.groupBy("queue", "block").agg(F.sum("n").alias("tokens")), "blocks")
    totals = {r.queue: r.n for r in blocks.groupBy("queue").agg(F.sum("tokens").alias("n")).collect()}
    named = None if weights is None else {f"source:{s}": w for s, w in weights.items()}
    plan = make_schedule(totals, named, size, period)
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(
        "queue", "block", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")
    )
    placed = tokenized.join(base, ["queue", "block"])
    return placed.select(
        "doc_id", "queue", (F.col("base") + F.col("place")).alias("position"), "n", "ids"
    ).mapInArrow(_cut(plan), PIECES)
