"""Saved tables: batches, replacement, modes, increments, streams."""

import os

import pytest

from conftest import as_documents
from folioseek import (
    DocumentIndex,
    advanced_search,
    documents_from_records,
    index_arrivals,
    index_changed_documents,
    index_documents,
    index_new_files,
    search_documents,
)

FIRST = [("/d/a", "csv", "alpha beta"), ("/d/b", "csv", "beta gamma gamma")]


def opened(spark, path):
    return DocumentIndex(spark, str(path))


def write(spark, path, rows, **options):
    DocumentIndex.create(spark, str(path))
    return index_documents(opened(spark, path), as_documents(spark, rows), **options)


def state(index):
    """All that searching depends on, comparable between indexes."""
    terms = {tuple(row) for row in index.term_stats().collect()}
    fields = {name: (row["n"], row["avgdl"]) for name, row in index.field_stats.items()}
    columns = ("field", "term", "file_path", "tf", "dl")
    postings = sorted(tuple(row) for row in index.postings().select(*columns).collect())
    return terms, fields, postings


def contents(index):
    return {row["file_path"]: row["content"] for row in index.documents().collect()}


def test_create_leaves_an_existing_index_alone(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    again = DocumentIndex.create(spark, str(tmp_path), analyzer="pt")
    assert again.analyzer == "standard" and again.count_documents() == 2


def test_replacing_equals_a_fresh_index(spark, tmp_path):
    write(spark, tmp_path / "log", FIRST)
    write(spark, tmp_path / "log", [("/d/b", "csv", "delta"), ("/d/c", "pdf", "gamma")])
    write(spark, tmp_path / "log", [("/d/b", "csv", "beta epsilon")])
    final = [FIRST[0], ("/d/b", "csv", "beta epsilon"), ("/d/c", "pdf", "gamma")]
    write(spark, tmp_path / "new", final)
    log, new = opened(spark, tmp_path / "log"), opened(spark, tmp_path / "new")
    assert log.count_documents() == log.documents().count() == 3
    assert contents(log) == contents(new)
    assert state(log) == state(new)
    assert search_documents(log, "delta").collect() == []
    for text in ("beta", "gamma", "epsilom"):
        found = [
            [(row["file_path"], row["score"]) for row in search_documents(index, text).collect()]
            for index in (log, new)
        ]
        assert found[0] == found[1]


def test_indexing_again_changes_nothing(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    before = state(opened(spark, tmp_path))
    write(spark, tmp_path, FIRST)
    assert state(opened(spark, tmp_path)) == before


def test_compact_keeps_the_state(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    write(spark, tmp_path, [("/d/b", "csv", "delta")])
    index = opened(spark, tmp_path)
    before, texts = state(index), contents(index)
    index.compact()
    after = opened(spark, tmp_path)
    assert len(after.batches) == 1 and after.superseded() is None
    assert state(after) == before and contents(after) == texts


def test_overwrite_replaces_everything(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    write(spark, tmp_path, [("/d/z", "csv", "omega")], mode="overwrite")
    assert list(contents(opened(spark, tmp_path))) == ["/d/z"]
    with pytest.raises(ValueError):
        write(spark, tmp_path, FIRST, mode="ignore")


def test_open_index_is_a_snapshot(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    before = opened(spark, tmp_path)
    write(spark, tmp_path, [("/d/c", "csv", "alpha")])
    assert len(search_documents(before, "alpha").collect()) == 1
    assert len(search_documents(opened(spark, tmp_path), "alpha").collect()) == 2


def test_uncommitted_leftovers_are_ignored_and_replaced(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    left = tmp_path / "documents" / "batch_id=2" / "outcome=indexed"
    opened(spark, tmp_path).documents().limit(1).drop("batch_id").write.parquet(str(left))
    assert opened(spark, tmp_path).documents().count() == 2
    write(spark, tmp_path, [("/d/c", "csv", "alpha")])
    assert set(contents(opened(spark, tmp_path))) == {"/d/a", "/d/b", "/d/c"}


def test_bad_rows_are_quarantined(spark, tmp_path):
    rows = as_documents(spark, FIRST + [("/d/e", "csv", ""), ("/d/s", "csv", " ")])
    rows = rows.selectExpr(
        "file_name",
        "if(file_path = '/d/a', NULL, file_path) AS file_path",
        "file_type",
        "content",
        "file_size",
    )
    DocumentIndex.create(spark, str(tmp_path))
    batch = index_documents(opened(spark, tmp_path), rows)
    assert (batch.indexed, batch.quarantined) == (2, 2)
    reasons = {row["reason"] for row in batch.failed.collect()}
    assert reasons == {"missing_path", "empty_content"}
    assert set(contents(opened(spark, tmp_path))) == {"/d/b", "/d/s"}


def test_only_bad_rows(spark, tmp_path):
    batch = write(spark, tmp_path, [("/d/e", "csv", "")])
    assert (batch.indexed, batch.quarantined) == (0, 1)
    assert advanced_search(opened(spark, tmp_path)).collect() == []
    assert search_documents(opened(spark, tmp_path), "x").collect() == []


def test_repeated_paths_in_one_batch(spark, tmp_path):
    batch = write(spark, tmp_path, [("/d/a", "csv", "one"), ("/d/a", "csv", "two")])
    assert batch.indexed == 1 and opened(spark, tmp_path).documents().count() == 1


def test_empty_input(spark, tmp_path):
    DocumentIndex.create(spark, str(tmp_path))
    empty = documents_from_records(spark, [])
    assert empty.columns == ["file_name", "file_path", "file_type", "content", "file_size"]
    batch = index_documents(opened(spark, tmp_path), empty)
    assert batch.batch_id is None and opened(spark, tmp_path).batches == []


def test_records(spark):
    names = ("file_name", "file_path", "file_type", "content", "file_size")
    record = dict(zip(names, ("a", "/a", "csv", "x", 1)))
    assert documents_from_records(spark, [record]).first().asDict() == record


def test_changed_documents(spark, tmp_path):
    write(spark, tmp_path, FIRST)
    later = as_documents(spark, [FIRST[0], ("/d/b", "csv", "other"), ("/d/n", "csv", "new")])
    assert index_changed_documents(opened(spark, tmp_path), later).indexed == 2
    assert index_changed_documents(opened(spark, tmp_path), later).indexed == 0


def test_filters_on_dates_and_metadata(spark, tmp_path):
    rows = spark.sql(
        "SELECT concat('/m/', n) AS file_path, concat('n', n) AS file_name, 'pdf' AS file_type, "
        "'same words' AS content, n AS file_size, "
        "timestampadd(DAY, cast(n AS int), timestamp'2024-03-01 00:00:00Z') AS modified_at, "
        "timestampadd(DAY, cast(n AS int), timestamp'2023-03-01 00:00:00Z') AS created_at, "
        "map('author', if(n % 2 = 0, 'Ana', 'Rui')) AS metadata FROM range(6) AS r(n)"
    )
    DocumentIndex.create(spark, str(tmp_path))
    index_documents(opened(spark, tmp_path), rows)
    index = opened(spark, tmp_path)
    for text in (None, "words"):
        def found(**filters):
            hits = advanced_search(index, text, sort_by="file_size", sort_order="asc", **filters)
            return [row["file_size"] for row in hits.collect()]

        assert found(modified_from="2024-03-03T00:00:00Z") == [2, 3, 4, 5]
        assert found(modified_from="2024-03-02", modified_to="2024-03-03") == [1, 2]
        assert found(created_to="2023-03-02T00:00:00Z") == [0, 1]
        assert found(metadata={"author": "Ana"}) == [0, 2, 4]
        assert found(metadata={"author": "Ana"}, min_size=1) == [2, 4]
    newest = advanced_search(index, "words", sort_by="modified_at", size=1).first()
    assert newest["file_size"] == 5


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.csv").write_text(f"word\n{name}{name}{name}\n")
    return folder


def test_new_files_only(spark, tmp_path, inbox):
    DocumentIndex.create(spark, str(tmp_path / "index"))

    def run():
        return index_new_files(opened(spark, tmp_path / "index"), str(inbox)).indexed

    assert run() == 2
    assert run() == 0
    (inbox / "b.csv").write_text("word\nchanged\n")
    (inbox / "c.csv").write_text("word\nccc\n")
    os.utime(inbox / "c.csv", (1_000_000_000, 1_000_000_000))
    assert run() == 2
    assert opened(spark, tmp_path / "index").documents().count() == 3
    assert len(search_documents(opened(spark, tmp_path / "index"), "changed").collect()) == 1


def test_arrivals_are_indexed_once(spark, tmp_path, inbox):
    path, checkpoint = str(tmp_path / "index"), tmp_path / "checkpoint"
    index = DocumentIndex.create(spark, path)
    index_arrivals(index, str(inbox), str(checkpoint)).awaitTermination()
    assert opened(spark, path).count_documents() == 2
    (inbox / "c.csv").write_text("word\nccc\n")
    index_arrivals(index, str(inbox), str(checkpoint)).awaitTermination()
    after = opened(spark, path)
    assert after.count_documents() == 3 and len(after.batches) == 2
    # Forget that the last micro-batch finished: it is replayed and skipped.
    for name in ("1", ".1.crc"):
        os.rename(checkpoint / "commits" / name, tmp_path / f"kept-{name}")
    index_arrivals(index, str(inbox), str(checkpoint)).awaitTermination()
    assert opened(spark, path).batches == after.batches


def test_hidden_arrivals_are_indexed_once(spark, tmp_path):
    """Hidden files arrive by their time, and a replayed batch holds the same ones."""
    inbox, path, checkpoint = tmp_path / "in", str(tmp_path / "index"), tmp_path / "checkpoint"
    (inbox / "_old").mkdir(parents=True)
    (inbox / "_x.csv").write_text("word\nxxx\n")
    (inbox / "_old/y.csv").write_text("word\nyyy\n")
    (inbox / "plain.csv").write_text("word\nzzz\n")
    (inbox / "empty.csv").write_text("")
    index = DocumentIndex.create(spark, path)

    def run():
        index_arrivals(index, str(inbox), str(checkpoint)).awaitTermination()
        return opened(spark, path)

    first = run()
    assert first.count_documents() == 3 and first.quarantine().count() == 1
    assert run().batches == first.batches
    (inbox / "_late.csv").write_text("word\nlate\n")
    after = run()
    assert after.count_documents() == 4 and len(after.batches) == 2
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.rename(checkpoint / "commits" / name, tmp_path / f"kept-{name}")
    assert run().batches == after.batches
    names = {r.file_name for r in opened(spark, path).documents().collect()}
    assert names == {"_x.csv", "y.csv", "plain.csv", "_late.csv"}


def test_failed_files_settle(spark, tmp_path):
    """A second run over an unchanged folder writes no batch, broken files or not."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "good.csv").write_text("a\n1\n")
    (inbox / "bad.docx").write_bytes(b"no archive")
    DocumentIndex.create(spark, str(tmp_path / "index"))

    def run(**options):
        return index_new_files(opened(spark, tmp_path / "index"), str(inbox), **options)

    first = run()
    assert (first.indexed, first.quarantined) == (1, 1)
    assert run().batch_id is None
    assert run(retry_failed=True).quarantined == 1
    # Only the latest failure of a path is shown, and none once it is indexed.
    assert opened(spark, tmp_path / "index").quarantine().count() == 1
    (inbox / "bad.docx").unlink()
    (inbox / "bad.csv").write_text("b\n2\n")
    assert run().indexed == 1 and run().batch_id is None


def test_failed_documents_settle(spark, tmp_path):
    DocumentIndex.create(spark, str(tmp_path))
    rows = as_documents(spark, [("/s/a.csv", "csv", "text"), ("/s/b.csv", "csv", "")])
    assert index_changed_documents(opened(spark, tmp_path), rows).quarantined == 1
    assert index_changed_documents(opened(spark, tmp_path), rows).batch_id is None
    again = index_changed_documents(opened(spark, tmp_path), rows, retry_failed=True)
    assert again.quarantined == 1
    later = as_documents(spark, [("/s/b.csv", "csv", "found")])
    assert index_changed_documents(opened(spark, tmp_path), later).indexed == 1
    assert opened(spark, tmp_path).quarantine().count() == 0
