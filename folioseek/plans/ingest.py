"""Folders and records into the index."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.functions.decoders import Decoder
from folioseek.functions.text import normalize_text
from folioseek.operators.changes import new_or_changed, new_or_modified_files
from folioseek.operators.trends import scan_counters
from folioseek.plans.store import Batch, DocumentIndex
from folioseek.schema import FILE_TYPES
from folioseek.sources.extraction import extract_documents
from folioseek.sources.files import file_records, scan_folder


def process_folder(
    spark: SparkSession,
    folder: str,
    decoders: Mapping[str, Decoder] | None = None,
    normalize: bool = False,
) -> DataFrame:
    """Every supported file below a folder with its text or a reason."""
    return _documents(scan_folder(spark, folder), decoders, normalize)


def count_files(
    spark: SparkSession,
    folder: str,
    decoders: Mapping[str, Decoder] | None = None,
) -> DataFrame:
    """Files seen (all of them), files processed and bytes, per file type."""
    done = process_folder(spark, folder, decoders)
    seen = file_records(scan_folder(spark, folder, ()))
    kinds = ", ".join(f"'{kind}'" for kind in FILE_TYPES)
    other = seen.filter(f"file_type NOT IN ({kinds})").withColumn("reason", F.lit("unsupported"))
    columns = ("file_type", "file_size", "reason")
    return scan_counters(done.select(*columns).unionByName(other.select(*columns)))


def _documents(
    files: DataFrame, decoders: Mapping[str, Decoder] | None, normalize: bool
) -> DataFrame:
    documents = extract_documents(files, decoders)
    if normalize:
        documents = documents.withColumn("content", F.expr(normalize_text("content")))
    return documents


def index_documents(
    index: DocumentIndex,
    documents: DataFrame,
    mode: str = "append",
    unique_paths: bool = False,
) -> Batch:
    """Add documents; rows without a path or text are quarantined."""
    if documents.isEmpty():
        return Batch(None, 0, 0, index.quarantine().limit(0))
    return index.append(documents, mode, unique_paths=unique_paths)


def index_folder(
    index: DocumentIndex,
    folder: str,
    mode: str = "append",
    decoders: Mapping[str, Decoder] | None = None,
    normalize: bool = False,
) -> Batch:
    """Scan a folder, extract on the executors and index, as one batch."""
    files = scan_folder(index.spark, folder)
    return _index_files(index, files, mode, decoders, normalize)


def index_new_files(
    index: DocumentIndex,
    folder: str,
    decoders: Mapping[str, Decoder] | None = None,
    normalize: bool = False,
    retry_failed: bool = False,
) -> Batch:
    """Index only files that are new or whose size or time changed.

    A file that was set aside counts as known until it changes, unless
    `retry_failed`.
    Finding them reads no content. The span of their times and sizes is then
    pushed to the file source, so files outside it are not opened either.
    """
    files = scan_folder(index.spark, folder)
    changed = new_or_modified_files(file_records(files), index.known_files(not retry_failed))
    # One row: the bounds of the changed files.
    span = changed.agg(
        F.min("modified_at").alias("first"),
        F.max("modified_at").alias("last"),
        F.min("file_size").alias("least"),
        F.max("file_size").alias("most"),
    ).first()
    if span["first"] is None:
        return Batch(None, 0, 0, index.quarantine().limit(0))
    near = files.filter(
        F.col("modificationTime").between(span["first"], span["last"])
        & F.col("length").between(span["least"], span["most"])
    )
    wanted = near.join(
        changed.select(F.col("file_path").alias("path")), "path", "left_semi"
    )
    return _index_files(index, wanted, "append", decoders, normalize)


def index_changed_documents(
    index: DocumentIndex, documents: DataFrame, retry_failed: bool = False
) -> Batch:
    """Index only documents whose path is new or whose text changed.

    One that was set aside counts as known until it changes, unless `retry_failed`.
    """
    hashed = documents.withColumn("content_hash", F.sha2("content", 256))
    known = index.known_files(not retry_failed)
    return index_documents(index, new_or_changed(hashed, known))


def _index_files(
    index: DocumentIndex,
    files: DataFrame,
    mode: str,
    decoders: Mapping[str, Decoder] | None,
    normalize: bool,
) -> Batch:
    if files.select("path").isEmpty():
        return Batch(None, 0, 0, index.quarantine().limit(0))
    documents = _documents(files, decoders, normalize)
    return index.append(documents, mode, unique_paths=True)
