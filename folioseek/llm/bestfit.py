"""Best-fit-decreasing packing into token id matrices.

Documents are tokenized, an end id is added, and documents of more than `size`
ids are split losslessly: full rows first, then what remains. Within a bounded
buffer of one task, pieces are placed by decreasing length, each into the open
row with the least room that still holds it. Rows are found by a segment tree
over capacities. Nothing is shuffled; padding is what the last few rows of each
buffer lack.

A matrix row has `size` ids, padded with `pad_id`. Segments are the pieces in
it: `cu_seqlens` are their cumulative lengths (0 first), `resets` the columns
where position ids begin again at zero.

Cases: a null text is its end id alone; null and repeated ids and repeated rows
are each packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import word_tokens

MATRIX = (
    "matrix_id long, n_rows int, ids binary, cu_seqlens array<array<int>>, "
    "resets array<array<int>>, doc_ids array<array<bigint>>, starts array<array<bigint>>"
)
# Tokens that a task gathers before it packs them, and rows of a matrix.
BUFFER, ROWS = 1 << 22, 256


class CapacityTree:
    """Open rows by the room they have; finds the least room that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with room for `need`; it is taken out."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows as lists of item numbers; every length is at most `size`."""
    tree, rows = CapacityTree(size), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = tree.take(need)
        if found is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        if room > need:
            tree.add(room - need, row)
    return rows


def _matrices(
    docs: list[tuple[int | None, np.ndarray]], size: int, pad_id: int, dtype: str
) -> Iterator[dict]:
    doc_of, start_of, length_of = [], [], []
    for i, (_, ids) in enumerate(docs):
        starts = np.arange(0, len(ids), size)
        doc_of.append(np.full(len(starts), i))
        start_of.append(starts)
        length_of.append(np.minimum(len(ids) - starts, size))
    doc, start, length = map(np.concatenate, (doc_of, start_of, length_of))
    rows = best_fit_decreasing(length, size)
    for a in range(0, len(rows), ROWS):
        part = rows[a : a + ROWS]
        ids = np.full((len(part), size), pad_id, dtype)
        bounds = []
        for r, items in enumerate(part):
            ends = np.cumsum([0, *length[items]]).tolist()
            for k, item in enumerate(items):
                s = start[item]
                ids[r, ends[k] : ends[k + 1]] = docs[doc[item]][1][s : s + length[item]]
            bounds.append(ends)
        yield {
            "n_rows": len(part),
            "ids": ids.tobytes(),
            "cu_seqlens": bounds,
            "resets": [b[:-1] for b in bounds],
            "doc_ids": [[docs[doc[i]][0] for i in items] for items in part],
            "starts": [start[items].tolist() for items in part],
        }


def _packer(path: str, size: int, end_id: int, pad_id: int, dtype: str):
    types = {
        "matrix_id": pa.int64(),
        "n_rows": pa.int32(),
        "ids": pa.binary(),
        "cu_seqlens": pa.list_(pa.list_(pa.int32())),
        "resets": pa.list_(pa.list_(pa.int32())),
        "doc_ids": pa.list_(pa.list_(pa.int64())),
        "starts": pa.list_(pa.list_(pa.int64())),
    }
    schema = pa.schema(list(types.items()))
    end = np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers are unique and the same on every attempt of the task.
        next_id = TaskContext.get().partitionId() << 32
        buffer: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            for row in _matrices(buffer, size, pad_id, dtype) if buffer else ():
                yield pa.RecordBatch.from_pylist([row | {"matrix_id": next_id}], schema)
                next_id += 1
            buffer.clear()
            held = 0

        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                encoded = word_tokens(path, dtype).encode(batch.column(1).to_pylist())
                for doc, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    ids = np.frombuffer(data + end, dtype)
                    buffer.append((doc, ids))
                    held += len(ids)
                    if held >= BUFFER:
                        yield from flush()
        yield from flush()

    return run


def pack_best_fit(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 1,
    pad_id: int = 0,
    dtype: str = "<u2",
) -> DataFrame:
    """Matrices of packed ids of every document; see MATRIX for the columns."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_packer(tokenizer_path, size, end_id, pad_id, dtype), MATRIX)
