"""Removal of repeated byte strings by column-wise ordering of many strings.

Every byte is removed that lies in a string of `SPAN` bytes which also starts
in a document with a smaller id.

A column-wise construction inserts one symbol of every string each round, from
the right, and carries the order of all strings (the collection's
Burrows-Wheeler order) and the common prefixes of neighbours from one round to
the next. Its work is strings times length, so it is given short strings only:

1. Documents are put into chunks of some megabytes, written once as a table
   bucketed by chunk; later joins bring small tables to it and never deal out
   texts again.
2. Anchors: in every window of SPAN bytes the least hash of its K-byte strings.
   Equal windows have the same anchor at the same place, so only strings around
   equal anchors have to be ordered. An anchor's string reaches over all windows
   that it stands for: SPAN - K bytes to its left, SPAN from its start.
3. By anchor: strings that are equal as a whole need no ordering; all but those
   of the least document are removed whole. What is left, where an anchor has
   several different strings, is ordered column by column: after each of the last
   SPAN - K + 1 rounds, runs of neighbours with a common prefix of SPAN bytes are
   equal windows, and those of all but the least document are marked.
4. Marks return to their chunks, and the remaining bytes are hashed.

Rounds pass over their arrays in order; the arrays of one bucket of anchors take
the place of the external files, and Spark deals out and spills the buckets,
whose number follows the input. An anchor's distinct strings stay together in
one bucket: copies are folded before, so it is the count of different
surroundings of one passage that a task must hold (some 100 bytes each).

Whole strings are compared by 88 bits of hashes, different ones by their bytes.

Cases: a null text is empty; texts shorter than SPAN lose nothing; equal ids do
not remove one another, and a null id counts as the largest; repeated rows have
a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import saved

SPAN, K = 50, 20
LEFT = SPAN - K
WIDTH = LEFT + SPAN
CHUNK = 4 << 20
# Bytes of text whose anchors share a bucket.
BUCKET_BYTES = 16 << 20
# Windows looked at together.
STEP = 1 << 20
_NO_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    wide = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return wide[:, :width].tobytes()


def _widen(data: bytes, width: int) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :width] = narrow
    return wide.view("<u8").ravel()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    if reach < width:
        values = pick(values[: reach - width], values[width - reach :])
    return values


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, hash, hash of the whole string, bytes left, bytes right) of each anchor.

    `data` holds texts of `sizes` bytes one after the other; nothing reaches
    from one text into the next.
    """
    n, ends = len(data), np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    inverse = _powers(_BASE_INVERSE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
    found = []
    for a in range(0, n - SPAN + 1, STEP):
        b = min(a + STEP, n - SPAN + 1)
        grams = _mixed(
            (total[a + K : b + SPAN] - total[a : b + SPAN - K]) * inverse[a : b + SPAN - K]
        ) | np.uint64(1)
        least = _slide(grams, LEFT + 1, np.minimum)
        starts = np.arange(a, b)
        inside = starts + SPAN <= ends[np.searchsorted(ends, starts, side="right")]
        least[~inside] = 0
        pad = np.zeros(LEFT, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum)
        found.append(np.flatnonzero(most == grams) + a)
    place = np.unique(np.concatenate(found))
    text = np.searchsorted(ends, place, side="right")
    left = np.minimum(place - (ends - sizes)[text], LEFT)
    right = np.minimum(ends[text] - place, SPAN)
    fp = _mixed((total[place + K] - total[place]) * inverse[place])
    lo, hi = place - left, place + right
    whole = _mixed((total[hi] - total[lo]) * inverse[lo] + left.astype(np.uint64))
    return place, fp, whole, left, right


def equal_windows(
    group: np.ndarray, doc: np.ndarray, strings: np.ndarray, left: np.ndarray, right: np.ndarray
) -> np.ndarray:
    """For each string a bit mask of its windows that a smaller document has too.

    Strings (rows of WIDTH bytes, the anchor at column LEFT) are compared within
    their `group`. Round by round a column is inserted before the suffixes that
    are ordered already: the new order is the old one dealt out by symbol, and
    the common prefix of two neighbours is one more than the least common prefix
    between their old places.
    """
    m = len(group)
    mask = np.zeros(m, np.uint64)
    order = np.argsort(group, kind="stable")
    names = np.cumsum(np.diff(group[order], prepend=group[order][:1]) != 0)
    name = np.empty(m, np.int64)
    name[order] = names
    common = np.zeros(m + 1, np.int64)
    common[0] = -1
    common[1:m] = np.where(names[1:] == names[:-1], 0, -1)
    for column in range(WIDTH - 1, -1, -1):
        inside = (column >= LEFT - left[order]) & (column < LEFT + right[order])
        symbol = np.where(inside, strings[order, column], 0).astype(np.int64)
        # Columns outside a string are equal to nothing.
        key = (name[order] << 9) | np.where(inside, symbol + 1, 0)
        dealt = np.argsort(key, kind="stable")
        same = (key[dealt][1:] == key[dealt][:-1]) & inside[dealt][1:]
        before, after = dealt[:-1][same], dealt[1:][same]
        fresh = np.full(m + 1, -1, np.int64)
        ordered_name = name[order][dealt]
        fresh[1:m] = np.where(ordered_name[1:] == ordered_name[:-1], 0, -1)
        if len(before):
            ends = np.empty(2 * len(before), np.int64)
            ends[::2], ends[1::2] = before + 1, after + 1
            between = np.minimum.reduceat(common, ends)[::2]
            fresh[1:m][same] = np.minimum(between + 1, SPAN)
        order, common = order[dealt], fresh
        if column <= LEFT:
            first = np.flatnonzero(common[:m] < SPAN)
            runs = np.diff(np.append(first, m))
            least = np.repeat(np.minimum.reduceat(doc[order], first), runs)
            mask[order[doc[order] > least]] |= np.uint64(1 << column)
    return mask


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def close() -> pa.RecordBatch:
        nonlocal number, held
        row = {
            "chunk": number,
            "ids": list(ids),
            "sizes": [len(t) for t in texts],
            "data": b"".join(texts),
        }
        number += 1
        held = 0
        ids.clear()
        texts.clear()
        return pa.RecordBatch.from_pylist([row], _CHUNK)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            if held and held + len(raw) > CHUNK:
                yield close()
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield close()


_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64()))]
    + [("sizes", pa.list_(pa.int64())), ("data", pa.binary())]
)
_CHUNK_SQL = "chunk long, ids array<bigint>, sizes array<bigint>, data binary"
_ENTRY = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("place", pa.binary())]
    + [("fp", pa.binary()), ("whole", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary())]
)
_ENTRY_SQL = (
    "bucket long, chunk long, n long, place binary, fp binary, whole binary, ids binary, starts binary"
)
_MARK = pa.schema(
    [("chunk", pa.int64()), ("removed", pa.binary()), ("open", pa.binary()), ("open_fp", pa.binary())]
)
_MARK_SQL = "chunk long, removed binary, open binary, open_fp binary"
_STRING = pa.schema(
    [("bucket", pa.int64()), ("chunk", pa.int64()), ("place", pa.binary()), ("fp", pa.binary())]
    + [("doc", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("strings", pa.binary())]
)
_STRING_SQL = (
    "bucket long, chunk long, place binary, fp binary, doc binary, left binary, right binary, strings binary"
)
_WINDOW = pa.schema([("chunk", pa.int64()), ("place", pa.binary()), ("mask", pa.binary())])
_WINDOW_SQL = "chunk long, place binary, mask binary"


def _doc_ids(ids: list[int | None]) -> np.ndarray:
    return np.array([_NO_ID if i is None else i for i in ids], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _parts(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with its positions."""
    order = np.argsort(keys, kind="stable")
    if len(order):
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            yield int(keys[part[0]]), part


def _emit_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data = np.frombuffer(row["data"].as_buffer(), np.uint8)
            sizes = np.array(row["sizes"].as_py(), np.int64)
            place, fp, whole, _, _ = anchors(data, sizes)
            ids, starts = _doc_ids(row["ids"].as_py()), np.cumsum(sizes) - sizes
            # The bucket is the high part, so that 40 more bits name the anchor in it.
            for bucket, part in _parts((fp >> np.uint64(40)).astype(np.int64) % buckets):
                used = np.unique(np.searchsorted(starts, place[part], side="right") - 1)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "bucket": bucket,
                            "chunk": row["chunk"].as_py(),
                            "n": len(part),
                            "place": _narrow(place[part], 4),
                            "fp": _narrow(fp[part], 5),
                            "whole": _narrow(whole[part], 6),
                            "ids": ids[used].tobytes(),
                            "starts": starts[used].tobytes(),
                        }
                    ],
                    _ENTRY,
                )

    return run


def _settle(table: pa.Table) -> pa.Table:
    """Marks of one bucket of anchors: places removed whole, and places still open."""
    place, fp, whole, doc, chunk = [], [], [], [], []
    for row in _rows(table.to_batches()):
        at = _widen(row["place"].as_py(), 4)
        ids = np.frombuffer(row["ids"].as_py(), np.int64)
        starts = np.frombuffer(row["starts"].as_py(), np.int64)
        place.append(at)
        fp.append(_widen(row["fp"].as_py(), 5))
        whole.append(_widen(row["whole"].as_py(), 6))
        doc.append(ids[np.searchsorted(starts, at.view(np.int64), side="right") - 1])
        chunk.append(np.full(len(at), row["chunk"].as_py()))
    place, fp, whole, doc, chunk = map(np.concatenate, (place, fp, whole, doc, chunk))
    order = np.argsort(fp, kind="stable")
    # Only anchors that two documents have can matter; that is found by anchor alone.
    first = np.flatnonzero(np.diff(fp[order], prepend=~fp[order][:1]) != 0)
    runs = np.diff(np.append(first, len(order)))
    docs = doc[order]
    shared = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
    order = order[np.repeat(shared, runs)]
    if not len(order):
        return _MARK.empty_table()
    order = order[np.lexsort((doc[order], whole[order], fp[order]))]
    new_fp = np.diff(fp[order], prepend=~fp[order][:1]) != 0
    new_whole = new_fp | (np.diff(whole[order], prepend=~whole[order][:1]) != 0)
    copy = np.cumsum(new_whole) - 1
    removed = doc[order] > doc[order][np.flatnonzero(new_whole)][copy]
    anchor = np.cumsum(new_fp) - 1
    several = np.bincount(anchor[new_whole]) > 1
    still = ~removed & several[anchor]
    rows = []
    for name, part in _parts(chunk[order]):
        gone, rest = order[part[removed[part]]], order[part[still[part]]]
        rows.append(
            {
                "chunk": name,
                "removed": _narrow(place[gone], 4),
                "open": _narrow(place[rest], 4),
                "open_fp": _narrow(fp[rest], 5),
            }
        )
    return pa.Table.from_pylist(rows, _MARK)


def _bounds(row: dict, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bytes left and bytes right of places of a chunk."""
    sizes = np.array(row["sizes"].as_py(), np.int64)
    ends = np.cumsum(sizes)
    text = np.searchsorted(ends, place, side="right")
    left = np.minimum(place - (ends - sizes)[text], LEFT)
    return text, left, np.minimum(ends[text] - place, SPAN)


def _joined(parts, width: int) -> np.ndarray:
    return _widen(b"".join(x for x in (parts.as_py() or []) if x), width).view(np.int64)


def _emit_strings(buckets_of_fp: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            place, fp = _joined(row["open"], 4), _joined(row["open_fp"], 5)
            if not len(place):
                continue
            data = np.frombuffer(row["data"].as_buffer(), np.uint8)
            text, left, right = _bounds(row, place)
            ids = _doc_ids(row["ids"].as_py())
            padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(SPAN, np.uint8)])
            for bucket, part in _parts(fp % buckets_of_fp):
                strings = padded[place[part][:, None] + np.arange(WIDTH)]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "bucket": bucket,
                            "chunk": row["chunk"].as_py(),
                            "place": _narrow(place[part], 4),
                            "fp": _narrow(fp[part], 5),
                            "doc": ids[text[part]].tobytes(),
                            "left": left[part].astype(np.uint8).tobytes(),
                            "right": right[part].astype(np.uint8).tobytes(),
                            "strings": strings.tobytes(),
                        }
                    ],
                    _STRING,
                )

    return run


def _order_columns(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    join = {c: b"".join(r[c] for r in rows) for c in ("place", "fp", "doc", "left", "right", "strings")}
    place, fp = _widen(join["place"], 4), _widen(join["fp"], 5)
    chunk = np.repeat([r["chunk"] for r in rows], [len(r["place"]) // 4 for r in rows])
    mask = equal_windows(
        fp.view(np.int64),
        np.frombuffer(join["doc"], np.int64),
        np.frombuffer(join["strings"], np.uint8).reshape(-1, WIDTH),
        np.frombuffer(join["left"], np.uint8).astype(np.int64),
        np.frombuffer(join["right"], np.uint8).astype(np.int64),
    )
    marked = np.flatnonzero(mask)
    found = [
        {
            "chunk": name,
            "place": _narrow(place[marked[part]], 4),
            "mask": _narrow(mask[marked[part]], 4),
        }
        for name, part in _parts(chunk[marked])
    ]
    return pa.Table.from_pylist(found, _WINDOW)


def _removed_bytes(row: dict, n: int) -> np.ndarray:
    """Which bytes of a chunk go."""
    whole = _joined(row["removed"], 4)
    _, left, right = _bounds(row, whole)
    place, mask = _joined(row["place"], 4), _joined(row["mask"], 4)
    starts, ends = [whole - left], [whole + right]
    for column in range(LEFT + 1):
        hit = place[mask >> column & 1 == 1] - LEFT + column
        starts.append(hit)
        ends.append(hit + SPAN)
    change = np.bincount(np.concatenate(starts), minlength=n + 1)
    change = change - np.bincount(np.concatenate(ends), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64())]
        + [("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    )
    for row in _rows(batches):
        data = np.frombuffer(row["data"].as_buffer(), np.uint8)
        gone = _removed_bytes(row, len(data))
        out, at = [], 0
        for doc, size in zip(row["ids"].as_py(), row["sizes"].as_py(), strict=True):
            own, drop = data[at : at + size], gone[at : at + size]
            at += size
            spans = np.count_nonzero(np.diff(drop, prepend=False) & drop)
            kept = hashlib.sha256(own[~drop].tobytes()).hexdigest()
            out.append((doc, size, int(drop.sum()), int(spans), kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
            schema=schema,
        )


def _chunk_table(docs: DataFrame, id_col: str) -> DataFrame:
    """Chunks of texts as a table bucketed by chunk, with as many buckets as shuffles have."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")
    )
    name = f"chunks_{uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.mapInArrow(_chunks, _CHUNK_SQL)
        .write.option("compression", "zstd")
        .bucketBy(parts, "chunk")
        .saveAsTable(name)
    )
    return spark.table(name)


def _by_chunk(marks: DataFrame, *columns: str) -> DataFrame:
    lists = (F.collect_list(c).alias(c) for c in columns)
    return marks.groupBy("chunk").agg(*lists).hint("shuffle_hash")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Bytes, removed bytes, removed runs and the hash of what is kept of every row."""
    chunks = _chunk_table(docs, id_col)
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    buckets = (total or 0) // BUCKET_BYTES + 1
    entries = chunks.mapInArrow(_emit_anchors(buckets), _ENTRY_SQL)
    marks = saved(entries.groupBy("bucket").applyInArrow(_settle, _MARK_SQL), "marks")
    opened = chunks.join(_by_chunk(marks.select("chunk", "open", "open_fp"), "open", "open_fp"), "chunk")
    strings = opened.mapInArrow(_emit_strings(buckets), _STRING_SQL)
    windows = saved(strings.groupBy("bucket").applyInArrow(_order_columns, _WINDOW_SQL), "windows")
    full = chunks.join(_by_chunk(marks.select("chunk", "removed"), "removed"), "chunk", "left").join(
        _by_chunk(windows, "place", "mask"), "chunk", "left"
    )
    result = full.mapInArrow(_finish, DIGEST)
    return result.withColumnRenamed("doc_id", id_col)
