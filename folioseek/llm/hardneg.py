"""Hard negatives by slots between the positives' upper limits.

Scores are integer inner products of quantised vectors: floor(scale * x) for
each component. An anchor's positives are its best rows of the same label; for
each of them, negatives are the best rows of another label whose score lies in
a share of the positive's score, so that near copies of the positive (false
negatives) and easy rows are both left out.

The windows of one anchor overlap: each begins at its own upper limit and
reaches downwards. The distinct upper limits split the scores into disjoint
slots, highest first. A row falls into one slot at most, and only the best `k`
of each slot can be asked for, so every task keeps `k` rows for each anchor and
slot (a combiner) and sends no more. Put together in descending order, the rows
below an upper limit are a suffix of the list: its first `k` rows, cut at the
window's lower limit, answer that window.

All rows meet all anchors, in blocks: rows and anchors are packed into tables of
matrices and joined on the number of an anchor block and a slice of the rows.
Spark broadcasts the anchors if their table is small. Products are exact: in
single or double precision as long as every sum fits its mantissa, in Python's
integers beyond.

Cases: rows with a null label, id or vector, or with a null or non-finite
component take no part; missing components of shorter vectors count as zero;
rows with the anchor's id are not its positives; repeated rows count each, but a
repeated anchor is answered once; an anchor without positives, a positive with a
negative score and a window without rows give no rows; an empty table gives
none; other columns are ignored. Scores must stay below 2^56 in size.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

# Rows of a packed block, anchors of a block, blocks of rows that one key brings together,
# and anchor blocks that a task keeps results of at a time.
ROWS, ANCHORS, SLICE, HELD = 4096, 1024, 8, 64
# Columns compared at first; later ones are many, as most then fall below what is kept.
FIRST = 256

BLOCK = "n long, dim long, kind string, ids binary, labels binary, parts binary"
FOUND = "a long, at long, anchor_id long, slot int, score long, id long"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """`id`, `label` and `v` of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        rows.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(label_col).cast("long").alias("label"),
            F.col(vector_col).cast("array<double>").alias("v"),
        )
        .filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
        .filter(~bad)
    )


def _packed(batch: pa.RecordBatch, scale: int) -> list:
    """n, dim, kind, ids, labels, parts of a batch of (id, label, v)."""
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column("v")
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    dim = int(sizes.max(initial=0))
    values = np.zeros((len(ids), dim))
    values[np.arange(dim) < sizes[:, None]] = np.asarray(lists.flatten(), np.float64)
    parts = np.floor(scale * values)
    kind = "f4" if np.abs(parts).max(initial=0) < 1 << 24 else "f8"
    return [len(ids), dim, kind, ids.tobytes(), labels.tobytes(), parts.astype(kind).tobytes()]


def _rows_of(found: list[list], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [item.strip().split() for item in schema.split(",")]
    columns = list(zip(*found, strict=True)) if found else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)],
        [name for name, _ in fields],
    )


def _pack_rows(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield _rows_of([_packed(batch.slice(at, ROWS), scale)], BLOCK)

    return run


def _pack_anchors(scale: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().sort_by("id").to_batches()[0]
        return pa.Table.from_batches([_rows_of([[key[0].as_py(), *_packed(batch, scale)]], "a long, " + BLOCK)])

    return run


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict, tag: str = ""):
        self.n, self.dim = row[tag + "n"], row[tag + "dim"]
        self.ids = np.frombuffer(row[tag + "ids"], np.int64)
        self.labels = np.frombuffer(row[tag + "labels"], np.int64)
        self.parts = np.frombuffer(row[tag + "parts"], row[tag + "kind"]).reshape(self.n, self.dim)
        self.most = float(np.abs(self.parts).max(initial=0))

    def scores(self, other: Block, columns: slice) -> np.ndarray:
        """Exact inner products with rows of another block."""
        dim = min(self.dim, other.dim)
        ours, theirs = self.parts[:, :dim], other.parts[columns, :dim]
        most = self.most * other.most * max(dim, 1)
        if most < 1 << 24:
            return ours.astype(np.float32) @ theirs.astype(np.float32).T
        if most < 1 << 53:
            return ours.astype(np.float64) @ theirs.astype(np.float64).T
        whole = [[[int(x) for x in row] for row in m] for m in (ours, theirs)]
        exact = [[sum(map(int.__mul__, x, y)) for y in whole[1]] for x in whole[0]]
        return np.array(exact, np.int64).reshape(self.n, len(theirs))


class Best:
    """The best `k` rows of each anchor and slot so far: a task's combiner.

    `uppers` holds the slots' upper limits of each anchor, descending, and `low`
    the score below which nothing is asked for.
    """

    def __init__(self, anchors: Block, k: int, uppers: np.ndarray | None = None, low: np.ndarray | None = None):
        least = np.iinfo(np.int64).min
        self.anchors, self.k, self.same = anchors, k, uppers is None
        self.uppers = np.full((anchors.n, 1), np.iinfo(np.int64).max) if self.same else uppers
        low = np.full(anchors.n, least) if self.same else low
        # A slot ends above the next one's upper limit.
        below = np.hstack([self.uppers[:, 1:] + 1, low[:, None]])
        self.bounds = np.maximum(below, low[:, None])
        self.found = np.zeros((0, 4), np.int64)  # anchor, slot, score, id

    def take(self, rows: Block) -> None:
        start, size = 0, FIRST
        while start < rows.n:
            columns = slice(start, min(start + size, rows.n))
            self._take(rows, columns)
            start, size = columns.stop, size * 4

    def _take(self, rows: Block, columns: slice) -> None:
        scores = self.anchors.scores(rows, columns)
        # Limits beyond all scores may shrink to their type.
        reach = int(np.abs(scores).max(initial=0)) + 1
        uppers, bounds = (np.clip(x, -reach, reach).astype(scores.dtype) for x in (self.uppers, self.bounds))
        alike = self.anchors.labels[:, None] == rows.labels[None, columns]
        if self.same:
            alike &= self.anchors.ids[:, None] != rows.ids[None, columns]
        fits = alike if self.same else ~alike
        parts = []
        for slot in range(self.uppers.shape[1]):
            held = fits & (scores <= uppers[:, slot, None]) & (scores >= bounds[:, slot, None])
            anchor, row = np.nonzero(held)
            parts.append(
                np.column_stack(
                    [anchor, np.full(len(anchor), slot), scores[anchor, row].astype(np.int64), rows.ids[columns][row]]
                )
            )
        new = np.concatenate(parts)
        if not len(new):
            return
        found = np.concatenate([self.found, new])
        found = found[np.lexsort((found[:, 3], -found[:, 2], found[:, 1], found[:, 0]))]
        first = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]
        starts = np.flatnonzero(first)
        place = np.arange(len(found)) - starts[np.cumsum(first) - 1]
        self.found = found[place < self.k]
        # From now on a row must reach the last one kept of a full slot; equal scores go by id.
        last = found[place == self.k - 1]
        self.bounds[last[:, 0], last[:, 1]] = last[:, 2]

    def rows(self, number: int) -> pa.RecordBatch:
        anchor, slot, score, ids = self.found.T
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(ids), number, np.int64)),
                pa.array(anchor),
                pa.array(self.anchors.ids[anchor]),
                pa.array(slot.astype(np.int32)),
                pa.array(score),
                pa.array(ids),
            ],
            ["a", "at", "anchor_id", "slot", "score", "id"],
        )


def _limits(row: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits, descending, and lower limit of each anchor of a block; no limits, no slots."""
    most = max((len(x["uppers"]) for x in row["limits"]), default=1)
    least = np.iinfo(np.int64).min
    uppers, low = np.full((n, most), least), np.full(n, np.iinfo(np.int64).max)
    for x in row["limits"]:
        uppers[x["at"], : len(x["uppers"])] = x["uppers"]
        low[x["at"]] = x["low"]
    return uppers, low


def _search(k: int, with_limits: bool):
    """mapInArrow over joined blocks: the best rows of each anchor and slot in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Best] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("a", *_names())}
                number = row["a"]
                if number not in held:
                    anchor_row = {name: batch.column(name)[i].as_py() for name in _names("a_")}
                    anchors = Block(anchor_row, "a_")
                    limits = ()
                    if with_limits:
                        limits = _limits({"limits": batch.column("limits")[i].as_py()}, anchors.n)
                    held[number] = Best(anchors, k, *limits)
                    if len(held) > HELD:
                        old, best = held.popitem(last=False)
                        yield best.rows(old)
                held[number].take(Block(row))
        for number, best in held.items():
            yield best.rows(number)

    return run


def _names(tag: str = "") -> list[str]:
    return [tag + item.split()[0] for item in BLOCK.split(", ")]


def _meet(blocks: DataFrame, anchors: DataFrame, many: int, slices: int) -> DataFrame:
    """Every block of rows beside every block of anchors, by an equi-join on a grid of keys."""
    ours = blocks.select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("a"),
        F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice"),
    )
    theirs = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return ours.join(theirs, ["a", "slice"])


def _best_rows(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def mine(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """Negatives (rank, id, score) of every anchor and positive.

    Anchors are rows whose id is divisible by `every`; `low` and `high` are hundredths
    of the positive's score.
    """
    known = usable(rows, id_col, vector_col, label_col)
    blocks = saved(known.mapInArrow(_pack_rows(scale), BLOCK), "vectors")
    asked = known.filter(F.col("id") % every == 0).distinct()
    many = max(1, -(-asked.count() // ANCHORS))
    number = F.pmod(F.xxhash64("id", "label", "v"), F.lit(many)).alias("a")
    anchors = saved(
        asked.select("*", number).groupBy("a").applyInArrow(_pack_anchors(scale), "a long, " + BLOCK), "anchors"
    )
    anchors = anchors.select("a", *(F.col(n).alias("a_" + n) for n in _names()))
    slices = max(1, blocks.count() // SLICE)

    joined = _meet(blocks, anchors, many, slices)
    best = _best_rows(joined.mapInArrow(_search(positives, False), FOUND), positives, "a", "at")
    # Within a window a score is between two shares of the positive's, so that one is not negative.
    pairs = saved(
        best.filter("score >= 0").select(
            "a",
            "at",
            "anchor_id",
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            F.expr(f"score * {high} DIV 100").alias("upper"),
            F.expr(f"(score * {low} + 99) DIV 100").alias("lower"),
        ),
        "positives",
    )
    windows = pairs.groupBy("a", "at").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("low")
    )
    limits = windows.groupBy("a").agg(F.collect_list(F.struct("at", "uppers", "low")).alias("limits"))
    bounded = saved(anchors.join(limits, "a"), "bounded_anchors")
    found = _meet(blocks, bounded, many, slices).mapInArrow(_search(negatives, True), FOUND)
    # At most `positives * negatives` rows of an anchor are left; descending, a slot follows the one above.
    merged = (
        _best_rows(found, negatives, "a", "at", "slot")
        .groupBy("a", "at")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("ranked"))
    )
    suffix = F.filter("ranked", lambda x: x["down"] >= -F.col("upper"))
    window = F.filter(F.slice(suffix, 1, negatives), lambda x: x["down"] <= -F.col("lower"))
    answered = pairs.join(merged, ["a", "at"]).select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(window).alias("place", "hit")
    )
    return answered.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).alias("rank"),
        F.col("hit.id").alias("negative_id"),
        "positive_score",
        (-F.col("hit.down")).alias("negative_score"),
    )

