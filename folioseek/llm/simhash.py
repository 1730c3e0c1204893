"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits: bit b is set if it is set in over half of the hashes
of the text's three-word shingles. Documents with one fingerprint are folded
into a class first, so copies cost one row. Fingerprints at two or fewer
differing bits are found by multi-index hashing over two 32-bit segments: one
of the segments differs in at most one bit, so each fingerprint looks up, in
the table of each segment, the small Hamming ball around its own segment:

- radius 0: the other segment differs in two bits or fewer, so one of its three
  parts is equal and is added to the key of the table;
- radius 1: the other segment differs in one bit or none, so one of its two
  halves is equal and is added to the key. Only zero bits are flipped: of a pair
  that differs in a bit, exactly one side has the zero.

Keys thus hold 42 bits or more, so that a hot segment value, as in a large group
of near copies, is no hot key. Matches are verified by their complete distance.
A fingerprint has at most 2,080 others that near, so links grow with the
input, and components are taken over fingerprints.

Cases: null and blank texts have fingerprint zero, linked like any other;
repeated rows and ids get a row each; an empty table gives no rows; a null id
counts as the largest one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, saved, split_words
from .components import components

BITS, SEGMENT = 64, 32
# Hashes that one task turns into bits at a time.
CHUNK = 1 << 16


def _shingle_hashes(text: Column, width: int) -> Column:
    """XXH64 (seed 42) of the space-joined shingles, repeats included."""
    words = F.col("words")
    n = F.size("words")
    joined = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(
            F.concat_ws(" ", F.get(words, i), *(F.get(words, i + k) for k in range(1, width)))
        ),
    )
    return (
        F.when(n >= width, joined)
        .when(n > 0, F.array(F.xxhash64(F.array_join("words", " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _bit_counts(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each row [start, end) of `values`: how often each of 64 bits is set."""
    counts = np.zeros((len(starts), BITS), np.int64)
    row_of = np.repeat(np.arange(len(starts)), ends - starts)
    for a in range(0, len(values), CHUNK):
        part = values[a : a + CHUNK].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row_of[a : a + CHUNK]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        counts[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return counts


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    for batch in batches:
        hashes = batch.column(1)
        offsets = np.asarray(hashes.offsets, np.int64)
        values = np.asarray(hashes.values)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = np.diff(offsets)
        counts = _bit_counts(values, offsets[:-1], offsets[1:])
        prints = ((2 * counts > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints.view(np.int64), pa.int64())], ["id", "fp"]
        )


def shingles(docs: DataFrame, id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """`id` and `hashes` of the shingles, repeats included, of every row of `docs`."""
    words = docs.select(F.col(id_col).alias("id"), split_words(ascii_lower(F.col("text"))).alias("words"))
    return words.select("id", _shingle_hashes(F.col("text"), width).alias("hashes"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """`id` and `fp` of every row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()
    return shingles(docs, id_col, width).mapInArrow(_fold, f"id {kind}, fp long")


def _segment(side: int) -> Column:
    return F.shiftrightunsigned("fp", SEGMENT * side).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def _part(value: Column, lo: int, hi: int) -> Column:
    return F.shiftrightunsigned(value, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


# (radius, bits of the other segment that stand in the key)
_TABLES = [(0, 0, 11), (0, 11, 22), (0, 22, 32), (1, 0, 16), (1, 16, 32)]


def _key(place: int, own: Column, other: Column, lo: int, hi: int) -> Column:
    return F.struct(F.lit(place).alias("t"), own.alias("s"), _part(other, lo, hi).alias("p"))


def _flips(own: Column) -> Column:
    """The segment with one of its zero bits set, for each of them."""
    bits = F.sequence(F.lit(0), F.lit(SEGMENT - 1))
    one = F.lit(1).cast("long")
    return F.filter(
        F.transform(bits, lambda b: own.bitwiseOR(F.call_function("shiftleft", one, b))),
        lambda x: x != own,
    )


def _probes(place: int, own: Column, other: Column, lo: int, hi: int) -> Column:
    return F.transform(_flips(own), lambda x: _key(place, x, other, lo, hi))


def near_links(prints: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints `fp` at two or fewer differing bits."""
    table, probe = [], []
    for side in (0, 1):
        own, other = _segment(side), _segment(1 - side)
        for t, (radius, lo, hi) in enumerate(_TABLES):
            where = (side * len(_TABLES) + t, own, other, lo, hi)
            table.append(_key(*where))
            probe.append(_probes(*where) if radius else F.array(_key(*where)))
    left = prints.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probe))).alias("k"))
    right = prints.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("k"))
    return (
        left.select("a", "k.*")
        .join(right.select("b", "k.*"), ["t", "s", "p"])
        .filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        .distinct()
    )


def near_components(docs: DataFrame, id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """id_col, `fp` and `component_id` (least id reachable) of every row."""
    rows = saved(fingerprints(docs, id_col, width), "prints")
    classes = saved(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    named = components(near_links(classes.select("fp")))
    groups = classes.join(
        named.select(F.col("node").alias("fp"), F.col("component").alias("group")), "fp", "left"
    ).select("fp", "least", F.coalesce("group", "fp").alias("group"))
    least = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    of_print = groups.join(least, "group").select("fp", "component_id")
    return rows.join(of_print, "fp", "left").select(
        F.col("id").alias(id_col), "fp", "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each group of near copies: that with the least id.

    Groups are found over texts, so that repeated and null ids lose no other text;
    an id goes before none, and of rows with one id and text any one stays.
    """
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    groups = near_components(docs.select(own.alias("own"), "text"), "own").select(
        F.col("own").alias("text_key"), F.col("component_id").alias("group")
    )
    rows = docs.select(F.col(id_col).alias("id"), own.alias("own")).groupBy("id", "own").agg(
        F.count(F.lit(1)).alias("copies")
    )
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own", "copies")
    first = (
        rows.join(groups.distinct(), F.col("own") == F.col("text_key"))
        .groupBy("group")
        .agg(F.min(place).alias("first"))
    )
    keep = saved(first.select("first.copies", F.col("first.id").alias("keep_id"), F.col("first.own").alias("keep")), "kept")
    same = (own == F.col("keep")) & F.col(id_col).eqNullSafe(F.col("keep_id"))
    once = docs.join(keep.filter("copies = 1").hint("shuffle_hash"), same, "left_semi")
    # Few rows are repeated whole; only they are shuffled again.
    again = docs.join(keep.filter("copies > 1").hint("shuffle_hash"), same).dropDuplicates(["keep"])
    return once.unionByName(again.select(docs.columns))
