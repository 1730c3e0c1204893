"""From documents to postings and their statistics."""

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioseek.functions.ranking import real, share_of_length
from folioseek.functions.text import listed_terms
from folioseek.operators.blocks import packed, unpacked
from folioseek.schema import BM25_K1, NAME_KEY_LENGTH, PATH_KEY_LENGTH, TEXT_FIELDS

# Mean length that postings are ordered by; any would do, as scores are computed in full.
USUAL_LENGTH = 300.0

# What postings are sorted and cut into ranges by.
_RANGE_KEYS = ("term_bucket", "term", "field", "_order", "_spread")

# Sampled postings for each range that reach the driver to find where it ends.
SAMPLED_ROWS = 200

_RUN = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ]
)
_RUNS = [T.StructField("dl", T.LongType()), T.StructField("runs", T.ArrayType(_RUN))]

FILE_COLUMNS = ("file_name", "file_type", "file_size", "created_at", "modified_at")


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


def term_bucket(term: Column, buckets: int | Column) -> Column:
    return F.pmod(term_hash(term), F.lit(buckets)).cast("int")


def frequency(positions: str) -> Column:
    return F.size(positions).cast("long")


def _in_order(postings: DataFrame, buckets: int) -> DataFrame:
    """Postings with the columns that they are clustered by."""
    # Falls with the share of its weight that a document earns, in steps of 1/10,000; lengths
    # count as against a usual one.
    weight = f"{real(BM25_K1)} * ({share_of_length('dl', USUAL_LENGTH)}) / tf"
    return (
        postings.withColumn("term_bucket", term_bucket(F.col("term"), buckets))
        .withColumn("_order", F.expr(f"floor({weight} * 10000D)"))
        .withColumn("_spread", F.xxhash64("file_path"))
    )


def range_borders(sample: DataFrame, buckets: int, ranges: int, share: float) -> list[tuple]:
    """Where postings are cut into `ranges`: the first key of each but the first.

    Found from a sample of postings, of which `share` reaches the driver: some
    SAMPLED_ROWS for each range.
    """
    rows = _in_order(sample, buckets).select(*_RANGE_KEYS)
    if share < 1:
        rows = rows.sample(share, seed=1)
    found = sorted(map(tuple, rows.collect()), key=lambda row: _as_bytes(row))
    return [found[len(found) * number // ranges] for number in range(1, ranges) if found]


def _as_bytes(row: tuple) -> tuple:
    """Texts are compared as UTF-8, like Spark does."""
    return tuple(value.encode() if isinstance(value, str) else value for value in row)


def clustered(postings: DataFrame, buckets: int, borders: list[tuple]) -> DataFrame:
    """Postings in ranges of bucket, term and weight, the heaviest range of a term first.

    A term of few documents lies in one file. One of many fills files of its own,
    so that a search for the best can leave the light ones closed. Equal weights
    are dealt out by path. Within a range postings lie by term and path. They are
    shuffled in blocks; what follows from other columns is computed on both sides.
    """
    ranged = _in_range(_in_order(postings, buckets), buckets, borders)
    blocks = packed(ranged.drop("_order", "_spread", "tf"))
    sent = T.StructType([item for item in postings.schema if item.name != "tf"])
    return (
        unpacked(blocks.repartitionById(len(borders) + 1, "_range"), sent)
        .withColumn("tf", frequency("positions"))
        .withColumn("term_bucket", term_bucket(F.col("term"), buckets))
        .sortWithinPartitions("term_bucket", "term", "field", "file_path")
        .select(*postings.columns, "term_bucket")
    )


def _in_range(rows: DataFrame, buckets: int, borders: list[tuple]) -> DataFrame:
    """Add `_range`, the number of borders that are not above a posting.

    Found by halving the borders of the posting's own bucket, so that the steps do not
    grow with the number of files. Terms that differ settle most comparisons.
    """
    if not borders:
        return rows.withColumn("_range", F.lit(0))
    below = [0] * (buckets + 1)
    for bucket, *_ in borders:
        below[bucket + 1] += 1
    step = 1 << max(below).bit_length() >> 1
    below = list(accumulate(below))
    starts = F.array(*map(F.lit, below))
    terms = F.array(*[F.lit(border[1]) for border in borders])
    others = F.array(*[_border(border[2:]) for border in borders])
    rows = rows.withColumn("_range", F.get(starts, F.col("term_bucket")))
    rows = rows.withColumn("_end", F.get(starts, F.col("term_bucket") + F.lit(1)))
    while step:
        before, last = F.col("_range"), F.col("_range") + F.lit(step - 1)
        past = (
            F.when(last >= F.col("_end"), False)
            .when(F.col("term") < F.get(terms, last), False)
            .when(F.col("term") > F.get(terms, last), True)
            .otherwise(F.struct(*_RANGE_KEYS[2:]) >= F.get(others, last))
        )
        rows = rows.withColumn("_range", F.when(past, before + F.lit(step)).otherwise(before))
        step >>= 1
    return rows.drop("_end")


def _border(values: tuple) -> Column:
    """What follows a border's bucket and term."""
    items = zip(_RANGE_KEYS[2:], ("string", "bigint", "bigint"), values)
    return F.struct(*[F.lit(value).cast(kind).alias(name) for name, kind, value in items])


def describe_files(postings: DataFrame) -> DataFrame:
    """A row per file and field of saved postings.

    Postings are counted by term first: the least and last of texts are found by
    sorting, which then meets the terms of each file only.
    """
    of_file = [F.col("_metadata.file_name").alias("file"), "term_bucket", "field"]
    terms = postings.groupBy(*of_file, "term").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("tf").alias("most_tf"),
        F.min(F.col("dl") / F.col("tf")).alias("least_ratio"),
    )
    return terms.groupBy("file", "term_bucket", "field").agg(
        F.min("term").alias("first_term"),
        F.max("term").alias("last_term"),
        F.sum("rows").alias("rows"),
        F.max("most_tf").alias("most_tf"),
        F.min("least_ratio").alias("least_ratio"),
    )


def _term_runs(kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Group each text's words: after `kept` columns, the words become dl and runs.

    A run is a term with its positions; runs are in the order of their terms. All of
    it happens inside the row, so building postings needs no shuffle.
    """

    # Nested, so that workers need not import this package.
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts, rows = batch.column(kept), batch.num_rows
            lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            words = texts.flatten()
            row = np.repeat(np.arange(rows), lengths)
            place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if words.null_count:  # stop words, which leave a gap
                there = words.is_valid().to_numpy(zero_copy_only=False)
                words, row, place = words.drop_null(), row[there], place[there]
            coded = words.dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            key = row * max(len(order), 1) + rank[coded.indices.to_numpy()]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            positions = pa.ListArray.from_arrays(
                pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[by], pa.int32())
            )
            terms = coded.dictionary.take(order).take(pa.array(key[first] % max(len(order), 1)))
            starts = np.searchsorted(key[first] // max(len(order), 1), np.arange(rows + 1))
            runs = pa.ListArray.from_arrays(
                pa.array(starts, pa.int32()),
                pa.StructArray.from_arrays([terms, positions], ["term", "positions"]),
            )
            counts = pa.array(np.bincount(row, minlength=rows), pa.int64())
            names = [*batch.schema.names[:kept], "dl", "runs"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], counts, runs], names=names)
        # Workers wait for later tasks, and would keep it.
        pa.default_memory_pool().release_unused()

    return grouped


def build_postings(
    documents: DataFrame,
    analyzer: str = "standard",
    fields: Iterable[str] = TEXT_FIELDS,
    keep: Iterable[str] = ("file_path",) + FILE_COLUMNS,
) -> DataFrame:
    """One row per document, field and term. Narrow: no shuffle."""
    kept = list(keep)
    texts = documents.select(
        *kept,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("field"), F.col(name).alias("text"))
                    for name in fields
                ]
            )
        ).alias("part"),
    )
    worded = texts.select(
        *kept, "part.field", F.expr(listed_terms("part.text", analyzer)).alias("words")
    )
    schema = T.StructType([*worded.schema.fields[:-1], *_RUNS])
    grouped = worded.mapInArrow(_term_runs(len(kept) + 1), schema)
    return grouped.select(
        *kept,
        "field",
        "dl",
        F.posexplode("runs").alias("n", "run"),
    ).select(
        "field",
        F.col("run.term").alias("term"),
        frequency("run.positions").alias("tf"),
        "dl",
        F.col("run.positions").alias("positions"),
        (F.col("n") == 0).alias("is_lead"),
        *kept,
    )


def count_terms(postings: DataFrame, sign: int = 1) -> DataFrame:
    """Documents, occurrences and lead postings of every term.

    Partial aggregation shrinks a frequent term to one row per task before the
    shuffle.
    """
    unit = F.lit(sign).cast("long")
    return postings.groupBy("field", "term").agg(
        F.sum(unit).alias("df"),
        F.sum(unit * F.col("tf")).alias("cf"),
        F.sum(F.when(F.col("is_lead"), unit).otherwise(F.lit(0).cast("long"))).alias(
            "docs"
        ),
    )


def merge_term_counts(counts: DataFrame) -> DataFrame:
    """Add up signed counts; terms no longer in use drop out."""
    return (
        counts.groupBy("field", "term")
        .agg(*[F.sum(name).alias(name) for name in ("df", "cf", "docs")])
        .filter((F.col("df") != 0) | (F.col("cf") != 0) | (F.col("docs") != 0))
    )


def field_counts(term_counts: DataFrame) -> DataFrame:
    return term_counts.groupBy("field").agg(
        F.sum("docs").alias("docs"), F.sum("cf").alias("tokens")
    )


def document_lengths(postings: DataFrame) -> DataFrame:
    """Length in terms of every document and field; a filter, not a grouping."""
    return postings.filter("is_lead").select("file_path", "batch_id", "field", "dl")


def name_key(name: Column) -> Column:
    return F.when(F.char_length(name) <= NAME_KEY_LENGTH, name)


def path_key(path: Column) -> Column:
    return F.when(F.char_length(path) <= PATH_KEY_LENGTH, path)


def sort_keys(documents: DataFrame) -> DataFrame:
    return documents.select(
        "file_path",
        name_key(F.col("file_name")).alias("name_key"),
        path_key(F.col("file_path")).alias("path_key"),
    )
