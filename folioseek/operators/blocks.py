"""Postings packed into blocks for their shuffle.

A row of its own for each posting carries its document's path, size and dates, which
makes most of what is shuffled. A block holds all that a task has for one range, with
the values of each text once, in the order of terms and texts, and compressed by column.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

# Postings and positions that a task holds before it packs them: some 100 bytes each.
PACKED_AT_ONCE = 1_500_000

# Rows that are handed back to Spark at once.
UNPACKED_AT_ONCE = 10_000

# Columns of a posting itself; all others belong to its text.
OF_POSTING = ("term", "positions", "is_lead")

_ARROW_TYPES = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "timestamp": pa.timestamp("us", tz="UTC"),
    "boolean": pa.bool_(),
}

Batches = Iterator[pa.RecordBatch]


def packed(postings: DataFrame) -> DataFrame:
    """A row per task and `_range` (or more, see PACKED_AT_ONCE), each column a blob.

    Rows have `_range` and `term_bucket` besides a posting's columns. Texts are told
    apart by their values, whatever the order of rows; alike rows in turn share a text.
    """
    texts = [
        name for name in postings.columns if name not in (*OF_POSTING, "_range", "term_bucket")
    ]
    schema = T.StructType(
        [T.StructField("_range", T.IntegerType())]
        + [T.StructField(name, T.BinaryType()) for name in (*texts, *OF_POSTING)]
    )
    return postings.mapInArrow(_packer(texts, PACKED_AT_ONCE), schema)


def unpacked(blocks: DataFrame, schema: T.StructType) -> DataFrame:
    """The postings of blocks, with the columns of `schema`."""
    texts = {
        item.name: _ARROW_TYPES[item.dataType.simpleString()]
        for item in schema
        if item.name not in OF_POSTING
    }
    return blocks.mapInArrow(_unpacker(schema.names, texts, UNPACKED_AT_ONCE), schema)


# The functions of tasks are nested, so that workers need not import this package.


def _packer(texts: list[str], at_once: int) -> Callable[[Batches], Batches]:
    def pack(batches: Batches) -> Batches:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codec = pa.Codec("zstd", compression_level=3)

        def by_byte(values: np.ndarray) -> bytes:
            """First bytes of all values, then second bytes: what is alike comes together."""
            return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()

        def blob(*parts: bytes) -> bytes:
            sizes = np.array([len(parts), *map(len, parts)], np.int32).tobytes()
            whole = b"".join([sizes, *parts])
            return len(whole).to_bytes(4, "little") + codec.compress(whole, asbytes=True)

        def of_column(column: pa.Array) -> list[bytes]:
            """Which values there are (if not all), lengths of strings, and the values."""
            if pa.types.is_boolean(column.type):
                column = column.cast(pa.int8())
            there = column.is_valid().to_numpy(zero_copy_only=False)
            known = b"" if there.all() else np.packbits(there, bitorder="little").tobytes()
            _, *buffers = column.buffers()
            if pa.types.is_string(column.type):
                ends = np.frombuffer(buffers[0], np.int32)[column.offset :][: len(column) + 1]
                data = buffers[1].to_pybytes()[ends[0] : ends[-1]] if buffers[1] else b""
                return [known, by_byte(np.diff(ends)), data]
            width = column.type.bit_width // 8
            values = np.frombuffer(buffers[0], f"V{width}")[column.offset :][: len(column)]
            return [known, by_byte(values)]

        def starts(batch: pa.RecordBatch) -> np.ndarray:
            """Rows whose text differs from that of the row before."""
            found = np.zeros(batch.num_rows, bool)
            found[0] = True
            for name in texts:
                column = batch.column(name)
                one, other = column.slice(1), column.slice(0, len(column) - 1)
                differ = pc.not_equal(one, other)
                if column.null_count:
                    differ = pc.coalesce(differ, pc.xor(one.is_valid(), other.is_valid()))
                found[1:] |= differ.to_numpy(zero_copy_only=False)
            return found

        def part_of(batch: pa.RecordBatch, texts_before: int) -> tuple:
            """What is held of a batch, as copies: a slice would hold the whole batch."""
            new = starts(batch)
            at = pa.array(np.flatnonzero(new))
            lists = batch.column("positions")
            return (
                [batch.column(name).take(at) for name in texts],
                batch.column("term").dictionary_encode(),
                (np.cumsum(new) - 1 + texts_before).astype(np.int32),
                batch.column("_range").to_numpy().copy(),
                batch.column("term_bucket").to_numpy().copy(),
                batch.column("is_lead").to_numpy(zero_copy_only=False),
                pc.list_value_length(lists).to_numpy().copy(),
                lists.flatten().to_numpy().copy(),
            )

        def in_order(values: pa.Array, by: pa.Array) -> tuple[pa.Array, np.ndarray]:
            """Sorted values, and the place that each had before."""
            place = np.empty(len(by), np.int32)
            place[by.to_numpy()] = np.arange(len(by), dtype=np.int32)
            return values.take(by), place

        def blocks(held: list[tuple]) -> pa.RecordBatch:
            columns, codes, *rest = zip(*held)
            text_of, ranges, buckets, leads, tf, positions = map(np.concatenate, rest)
            found = pa.RecordBatch.from_arrays([*map(pa.concat_arrays, zip(*columns))], names=texts)
            coded = pa.concat_arrays(pa.chunked_array(codes).unify_dictionaries().chunks)
            held.clear()
            del columns, codes, rest
            # By term, field and path, as they are sorted when saved.
            keys = [(name, "ascending") for name in ("field", "file_path") if name in texts]
            found, place = in_order(found, pc.sort_indices(found, sort_keys=keys))
            text_of = place[text_of]
            terms, place = in_order(coded.dictionary, pc.sort_indices(coded.dictionary))
            term_of = place[coded.indices.to_numpy()]
            by_term = term_of * np.int64(found.num_rows) + text_of
            order = np.lexsort((by_term, buckets, ranges))
            del by_term, buckets, coded
            text_of, term_of, ranges = text_of[order], term_of[order], ranges[order]
            ends = pa.array(np.append(0, np.cumsum(tf)), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(positions)).take(pa.array(order))
            leads, tf, positions = leads[order], tf[order], lists.flatten().to_numpy()
            ends = np.append(0, np.cumsum(tf))
            first = np.flatnonzero(np.diff(ranges, prepend=-1))
            rows = []
            for start, end in zip(first, [*first[1:], len(ranges)]):
                used, own = np.unique(text_of[start:end], return_inverse=True)
                block = found.take(pa.array(used))
                own_terms = term_of[start:end]
                new = np.flatnonzero(np.diff(own_terms, prepend=-1))
                runs = np.diff(np.append(new, end - start)).astype(np.int32)
                row = {name: blob(*of_column(block.column(name))) for name in texts}
                row["term"] = blob(by_byte(runs), *of_column(terms.take(pa.array(own_terms[new]))))
                row["positions"] = blob(
                    by_byte(own.astype(np.int32)),
                    by_byte(tf[start:end]),
                    by_byte(positions[ends[start] : ends[end]]),
                )
                row["is_lead"] = blob(np.packbits(leads[start:end], bitorder="little").tobytes())
                rows.append(row)
            names = [*texts, "term", "positions", "is_lead"]
            return pa.RecordBatch.from_arrays(
                [pa.array(ranges[first], pa.int32())]
                + [pa.array([row[name] for row in rows], pa.binary()) for name in names],
                names=["_range", *names],
            )

        held, size, texts_held = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(part_of(batch, texts_held))
            texts_held += len(held[-1][0][0])
            size += batch.num_rows + len(held[-1][-1])
            if size >= at_once:
                yield blocks(held)
                size, texts_held = 0, 0
                pa.default_memory_pool().release_unused()
        if held:
            yield blocks(held)
        # The worker waits for other tasks, beside those that sort.
        pa.default_memory_pool().release_unused()

    return pack


def _unpacker(
    names: list[str], texts: dict[str, pa.DataType], at_once: int
) -> Callable[[Batches], Batches]:
    def unpack(batches: Batches) -> Batches:
        import numpy as np
        import pyarrow as pa

        def parts(cell: pa.Scalar) -> list[memoryview]:
            data = cell.as_buffer()
            size = int.from_bytes(data[:4].to_pybytes(), "little")
            whole = pa.decompress(data[4:], decompressed_size=size, codec="zstd")
            count = int(np.frombuffer(whole, np.int32, 1)[0])
            ends = 4 * (count + 1) + np.cumsum([0, *np.frombuffer(whole, np.int32, count, 4)])
            return [whole.slice(int(a), int(b - a)) for a, b in zip(ends, ends[1:])]

        def values(part: pa.Buffer, width: int) -> np.ndarray:
            spread = np.frombuffer(part, np.uint8).reshape(width, -1)
            return np.ascontiguousarray(spread.T).reshape(-1)

        def offsets(part: pa.Buffer) -> np.ndarray:
            return np.append(0, np.cumsum(values(part, 4).view(np.int32))).astype(np.int32)

        def column(kind: pa.DataType, known: pa.Buffer, *rest: pa.Buffer) -> pa.Array:
            if pa.types.is_boolean(kind):
                return column(pa.int8(), known, *rest).cast(kind)
            known = known if known.size else None
            if pa.types.is_string(kind):
                ends = offsets(rest[0])
                found = [known, pa.py_buffer(ends), rest[1]]
                return pa.Array.from_buffers(kind, len(ends) - 1, found)
            width = kind.bit_width // 8
            found = [known, pa.py_buffer(values(rest[0], width))]
            return pa.Array.from_buffers(kind, rest[0].size // width, found)

        for batch in batches:
            for row in range(batch.num_rows):
                cells = {name: parts(batch.column(name)[row]) for name in names}
                runs, *found = cells["term"]
                runs = values(runs, 4).view(np.int32)
                own, tf, positions = cells["positions"]
                own = pa.array(values(own, 4).view(np.int32))
                leads = np.frombuffer(cells["is_lead"][0], np.uint8)
                which = pa.array(np.repeat(np.arange(len(runs)), runs))
                whole = {name: column(kind, *cells[name]).take(own) for name, kind in texts.items()}
                whole["term"] = column(pa.string(), *found).take(which)
                whole["positions"] = pa.ListArray.from_arrays(
                    pa.array(offsets(tf)), pa.array(values(positions, 4).view(np.int32))
                )
                whole["is_lead"] = pa.array(
                    np.unpackbits(leads, count=len(own), bitorder="little").astype(bool)
                )
                rows = pa.RecordBatch.from_arrays([whole[name] for name in names], names=names)
                for start in range(0, rows.num_rows, at_once):
                    yield rows.slice(start, at_once)

    return unpack
