"""Postings are shuffled in blocks, and saved and built with little disk."""

import datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import as_documents
from folioseek import DocumentIndex, index_documents, search_documents
from folioseek.operators import blocks
from folioseek.operators.postings import build_postings, clustered, range_borders
from folioseek.plans import store

KEPT = ("file_path", "file_name", "file_size", "modified_at", "created_at", "file_part")
SCHEMA = (
    "file_path string, file_name string, file_size long, modified_at timestamp, "
    "created_at timestamp, file_part int, content string"
)


def odd_documents(spark):
    """With nulls, texts beyond ASCII, a long one, and rows that come twice."""
    day = datetime.datetime(2024, 1, 1)
    rows = [
        (
            f"/é/{n % 50}.csv",
            None if n % 5 == 0 else f"n{n % 3}",
            None if n % 4 == 0 else n << 33,
            day + datetime.timedelta(hours=n) if n % 3 else None,
            None,
            n % 7,
            " ".join(["the"] * (n % 4) + [f"w{n * k % 61}" for k in range(n % 9)] + ["日本", "éa"]),
        )
        for n in range(120)
    ]
    rows[7] = (*rows[7][:-1], "the word " * 3000)
    return spark.createDataFrame(rows + rows[:9], SCHEMA)


@pytest.mark.parametrize("at_once", [40, 4_000_000])
@pytest.mark.parametrize("ranges", [1, 9])
def test_blocks_keep_all_postings(spark, monkeypatch, at_once, ranges):
    monkeypatch.setattr(blocks, "PACKED_AT_ONCE", at_once)
    built = build_postings(odd_documents(spark), keep=KEPT)
    dealt = clustered(built, 4, range_borders(built, 4, ranges, 1.0))
    assert dealt.drop("term_bucket").schema.simpleString() == built.schema.simpleString()
    rows = dealt.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(repr(row[: len(built.columns)]) for row in rows) == sorted(map(repr, map(tuple, built.collect())))
    for part in {row["part"] for row in rows}:
        keys = [(r["term_bucket"], r["term"].encode(), r["field"], r["file_path"].encode()) for r in rows if r["part"] == part]
        assert keys == sorted(keys)


def test_shuffle_has_a_row_per_task_and_range(spark):
    """Not one for each posting, with its document's columns again."""
    rows = [(f"/long/folder/of/{n}.csv", "csv", f"the common words w{n}") for n in range(400)]
    built = build_postings(as_documents(spark, rows).coalesce(2), keep=("file_path", "file_name"))
    dealt = clustered(built, 4, range_borders(built, 4, 6, 1.0))
    dealt.write.format("noop").mode("overwrite").save()
    plan = dealt._jdf.queryExecution().toString()
    below = plan[plan.rindex("Exchange") :]
    assert below.count("MapInArrow") == 2
    ranged = built.withColumns({"_range": F.lit(3), "term_bucket": F.lit(1)}).drop("tf")
    sent = blocks.packed(ranged)
    assert sent.count() == 2
    size = sum(len(value) for row in sent.collect() for value in row[1:])
    assert size < 8 * built.count()


def test_file_names_that_end_the_path_are_not_saved(spark, tmp_path):
    names = {"/n/a.csv": "a.csv", "/n/b.csv": "other.csv", "/n/c.csv": None, "d.csv": "d.csv", "/n/": ""}
    rows = [(name, path, "csv", "word", 4) for path, name in names.items()]
    documents = spark.createDataFrame(
        rows, "file_name string, file_path string, file_type string, content string, file_size long"
    )
    DocumentIndex.create(spark, str(tmp_path))
    index_documents(DocumentIndex(spark, str(tmp_path)), documents)
    index = DocumentIndex(spark, str(tmp_path))
    found = index.postings().filter("field = 'content'").select("file_path", "file_name").collect()
    assert {tuple(row) for row in found} == set(names.items())
    saved = spark.read.parquet(f"{tmp_path}/postings").select("file_name").distinct().collect()
    assert {row["file_name"] for row in saved} == {None, "other.csv"}
    hits = search_documents(index, "word", None).select("file_path", "file_name").collect()
    assert {tuple(row) for row in hits} == set(names.items())


def test_an_index_with_all_file_names_saved_is_read(spark, tmp_path):
    DocumentIndex.create(spark, str(tmp_path))
    index_documents(DocumentIndex(spark, str(tmp_path)), as_documents(spark, [("/n/a.csv", "csv", "word")]))
    before = DocumentIndex(spark, str(tmp_path)).postings()
    old = spark.createDataFrame(before.collect(), before.schema).drop("batch_id", "term_bucket")
    buckets = list(Path(tmp_path, "postings").glob("batch_id=*/term_bucket=*"))
    old.write.mode("overwrite").parquet(str(buckets[0]))
    found = DocumentIndex(spark, str(tmp_path)).posting_versions().collect()
    assert {row["file_name"] for row in found} == {"a.csv"}


def test_documents_and_postings_are_saved_in_zstd(make_index):
    index = make_index([("/z.csv", "csv", "word")])
    for table in ("documents", "postings"):
        for file in Path(index.path, table).rglob("*.parquet"):
            assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


@pytest.mark.parametrize("before", [None, "false"])
def test_indexing_removes_its_shuffle_files_as_it_goes(spark, tmp_path, monkeypatch, before):
    seen, write = [], DocumentIndex._write

    def watched(*args):
        seen.append(spark.conf.get(store.SHUFFLE_CLEANUP, None))
        return write(*args)

    monkeypatch.setattr(DocumentIndex, "_write", watched)
    if before:
        spark.conf.set(store.SHUFFLE_CLEANUP, before)
    found = spark.conf.get(store.SHUFFLE_CLEANUP, None)
    DocumentIndex.create(spark, str(tmp_path))
    index_documents(DocumentIndex(spark, str(tmp_path)), as_documents(spark, [("/z.csv", "csv", "word")]))
    assert seen == ["true"] and spark.conf.get(store.SHUFFLE_CLEANUP, None) == found
    spark.conf.unset(store.SHUFFLE_CLEANUP)
