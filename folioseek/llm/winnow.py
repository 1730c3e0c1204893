"""Benchmark decontamination by winnowing.

Both sides keep, of every `WINDOW - K + 1` neighbouring K-word hashes, the least
(the rightmost of equals). A shared span of WINDOW words has the same hashes on
both sides and so the same one kept: no such span is missed. Items of fewer than
WINDOW words are matched whole: for each length that occurs, all hashes of that
many words are kept (winnowing with windows of one).

Each kept hash carries its K words and up to WINDOW - K words on both sides.
Hashes of documents and benchmark are joined, and each hit is extended over
equal words to the left and right; a run of WINDOW words or more (or the whole
short item) is an occurrence. Words are compared themselves, so equal hashes of
different words do no harm.

Before the join, document hashes pass a bitmap of 2**22 bits that the benchmark
sets: its size is fixed at any size of benchmark, and it only saves rows.

Cases: null texts have no words; an id that repeats gets a row each, judged by
its own text; items that repeat an item_id count once; an empty benchmark hits
nothing; empty documents give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

WINDOW, K = 13, 9
SIDE = WINDOW - K
BITMAP_BITS = 22
# Texts hashed at a time, in bytes; a longer text is a chunk of its own.
CHUNK = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
# Bytes of words, after A-Z are lower-cased: digits, a-z and all of 0x80-0xFF.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_FIELDS = "at: bigint, fp: bigint, size: int, before: int, words: array<string>"
_MARKED = f"row: bigint, n_words: bigint, marks: array<struct<{_FIELDS}>>"


def item_words(text: str | None) -> list[str]:
    return [w.decode() for w in _WORD.findall((text or "").encode().translate(_LOWER))]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in the bytes."""
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    length = ends - starts
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    powers = _powers(_BASE, int(length.max()))
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = np.add.reduceat(values, np.cumsum(length) - length)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return starts, ends, hashes ^ (hashes >> np.uint64(32))


def _gram_hashes(hashes: np.ndarray, n: int, powers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Hash of each n neighbouring words: a difference of running sums, shifted back."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[: len(hashes)])])
    grams = (total[n:] - total[:-n]) * inverse[: len(hashes) - n + 1]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0x94D049BB133111EB)
    return grams ^ (grams >> np.uint64(30))


def _kept(grams: np.ndarray, window_ok: np.ndarray) -> np.ndarray:
    """Places of the rightmost least hash of each allowed window of neighbouring hashes."""
    n = SIDE + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, n)[window_ok]
    least = n - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.flatnonzero(window_ok) + least)


def _marks(texts: list[bytes], lengths: list[int], bitmap: np.ndarray | None, whole: bool):
    """(number of words, marks) of each text. `whole`: the texts are items, a short one one mark."""
    data = b"\n".join(texts).translate(_LOWER)
    raw = np.frombuffer(data, np.uint8)
    starts, ends, hashes = _word_hashes(raw)
    sizes = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    n_words = np.diff(bounds)
    stop = np.repeat(bounds[1:], n_words)
    powers, inverse = _powers(_BASE, len(hashes)), _powers(_BASE_INVERSE, len(hashes))
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    at = np.arange(len(hashes))

    def passing(grams: np.ndarray, places: np.ndarray, size: int) -> None:
        fps = grams[places] ^ np.uint64(size)
        if bitmap is not None:
            low = fps & np.uint64((1 << BITMAP_BITS) - 1)
            hit = bitmap[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1) == 1
            places, fps = places[hit], fps[hit]
        found.append((places, fps, size))

    if len(hashes) >= WINDOW:
        grams = _gram_hashes(hashes, K, powers, inverse)
        ok = (at + WINDOW <= stop)[: len(hashes) - WINDOW + 1]
        passing(grams, _kept(grams, ok), K)
    for n in lengths:
        if len(hashes) >= n:
            grams = _gram_hashes(hashes, n, powers, inverse)
            ok = (at + n <= stop)[: len(grams)]
            if whole:
                ok &= np.repeat(n_words == n, n_words)[: len(grams)]
            passing(grams, np.flatnonzero(ok), n)
    places = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    fps = np.concatenate([f[1] for f in found]).view(np.int64) if found else places
    size = np.concatenate([np.full(len(f[0]), f[2]) for f in found]) if found else places
    text_of = np.searchsorted(bounds, places, side="right") - 1
    out: list[list[dict]] = [[] for _ in texts]
    for p, fp, n, t in zip(places.tolist(), fps.tolist(), size.tolist(), text_of.tolist(), strict=True):
        side = SIDE if n == K and (not whole or n_words[t] >= WINDOW) else 0
        lo, hi = max(int(bounds[t]), p - side), min(int(bounds[t + 1]), p + n + side)
        words = [data[starts[i] : ends[i]].decode() for i in range(lo, hi)]
        out[t].append({"at": p - int(bounds[t]), "fp": fp, "size": n, "before": p - lo, "words": words})
    return n_words.tolist(), out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _marker(lengths: list[int], bitmap: np.ndarray | None, whole: bool):
    marks_type = pa.list_(
        pa.struct(
            [("at", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("before", pa.int32())]
            + [("words", pa.list_(pa.string()))]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                n_words, marks = _marks(texts[a:b], lengths, bitmap, whole)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n_words, pa.int64()), pa.array(marks, marks_type)],
                    ["id", "n_words", "marks"],
                )

    return run


def _marked(table: DataFrame, id_col: str, lengths: list[int], bitmap, whole: bool) -> DataFrame:
    """`id`, `n_words` and kept hashes of each row."""
    kind = table.schema[id_col].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    schema = f"id {kind}, n_words bigint, marks array<struct<{_FIELDS}>>"
    return rows.mapInArrow(_marker(lengths, bitmap, whole), schema)


def _short_lengths(benchmark: DataFrame) -> list[int]:
    """Lengths below WINDOW that items have: at most WINDOW - 1 numbers."""
    words = F.regexp_extract_all(
        F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.lit(_WORD.pattern.decode()),
        F.lit(0),
    )
    n = F.coalesce(F.size(words), F.lit(0))
    rows = benchmark.select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") < WINDOW))
    return sorted(r.n for r in rows.distinct().collect())


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the benchmark's hashes; at most 2**16 rows of 64 bits reach the driver."""
    low = F.col("fp").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = (
        items.select(F.shiftright(low, 6).alias("w"), low.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words:
        out[r.w] = r.bits
    return out.view(np.uint64)


def _extended(words: F.Column, other: F.Column, at: F.Column, item_at: F.Column, step: int) -> F.Column:
    """How many words are equal going from `at` by `step`, at most SIDE."""
    equal = F.lit(0)
    for d in range(SIDE, 0, -1):
        a, b = F.get(words, at + step * d), F.get(other, item_at + step * d)
        equal = F.when(F.coalesce(a == b, F.lit(False)), 1 + equal).otherwise(0)
    return equal


def hits(marked: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences (id, row_hash, start, stop, item_id): hash hits, extended over equal words."""
    left = marked.select("id", "key", F.explode("marks").alias("m")).select(
        "id", "key", "m.at", "m.fp", "m.size", "m.before", "m.words"
    )
    found = left.join(items, ["fp", "size"])
    core = F.slice("words", F.col("before") + 1, F.col("size"))
    item_core = F.slice("item_words", F.col("item_before") + 1, F.col("size"))
    last, item_last = F.col("before") + F.col("size") - 1, F.col("item_before") + F.col("size") - 1
    words, other = F.col("words"), F.col("item_words")
    found = found.filter(core == item_core).select(
        "id",
        "key",
        "item_id",
        "at",
        "size",
        "item_long",
        _extended(words, other, F.col("before"), F.col("item_before"), -1).alias("left"),
        _extended(words, other, last, item_last, 1).alias("right"),
    )
    long_run = F.col("left") + F.col("size") + F.col("right") >= WINDOW
    return found.filter(long_run | ~F.col("item_long")).select(
        "id",
        "key",
        "item_id",
        (F.col("at") - F.when(F.col("item_long"), F.col("left")).otherwise(0)).alias("start"),
        (F.col("at") + F.col("size") + F.when(F.col("item_long"), F.col("right")).otherwise(0)).alias("stop"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id"
) -> DataFrame:
    """Words, hit words, hit items and `contaminated` of every row of `docs`."""
    lengths = _short_lengths(benchmark)
    of_item = _marked(benchmark, item_col, lengths, None, True)
    items = saved(
        of_item.select(F.col("id").alias("item_id"), "n_words", F.explode("marks").alias("m"))
        .select(
            "item_id",
            (F.col("n_words") >= WINDOW).alias("item_long"),
            "m.fp",
            "m.size",
            F.col("m.before").alias("item_before"),
            F.col("m.words").alias("item_words"),
        )
        # Copies of an item, or of a phrase at one place of its window, are one row.
        .distinct(),
        "benchmark_marks",
    )
    bitmap = _bitmap(items)
    marked = saved(
        _marked(docs, id_col, lengths, bitmap, False).withColumn(
            "key", F.struct("n_words", F.xxhash64("marks").alias("h"))
        ),
        "document_marks",
    )
    found = saved(hits(marked.filter(F.size("marks") > 0), items).distinct(), "hits")
    by_row = ["id", "key"]
    spans = found.select(*by_row, "start", "stop").distinct()
    order = Window.partitionBy(*by_row).orderBy("start", "stop")
    reached = F.coalesce(
        F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    new = F.greatest(F.col("stop") - F.greatest(reached, F.col("start")), F.lit(0))
    n_hit = spans.withColumn("new", new).groupBy(*by_row).agg(F.sum("new").alias("n_hit"))
    item_list = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    items_of = found.select(*by_row, "item_id").distinct().groupBy(*by_row).agg(
        F.count(F.lit(1)).alias("n_items"), item_list.alias("items")
    )
    n_hit = n_hit.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "n_hit")
    # Null-safe, as rows without an id have hits like any other.
    both = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
    hit_rows = n_hit.join(items_of, both).select("hit_id", "hit_key", "n_hit", "n_items", "items")
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key"))
    hit_words = F.coalesce("n_hit", F.lit(0))
    return marked.select("id", "key", "n_words").join(hit_rows, same, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        hit_words.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit_words > 0) & (20 * hit_words >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id"
) -> DataFrame:
    """The rows of `docs` that are not contaminated, each judged by its own text."""
    own = F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.col("text").cast("binary")))
    judged = docs.select(own.alias("row"), "text")
    bad = contamination(judged, benchmark, "row").filter("contaminated")
    bad = bad.select(F.col("row").alias("bad_row")).distinct()
    return docs.join(bad, own == F.col("bad_row"), "left_anti")
