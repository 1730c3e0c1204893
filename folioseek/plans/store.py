"""The index as saved Parquet tables below one folder.

Every batch writes folders of its own and then one commit record. A batch
without a record does not exist for readers, and writing it again replaces its
leftovers, so a run that dies half way leaves nothing behind. Readers hold the
batches that were committed when they opened the index. One writer at a time.
"""

from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from uuid import uuid4

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from folioseek.functions.text import check_analyzer
from folioseek.operators.changes import (
    latest_versions,
    one_per_path,
    path_bucket,
    replaced_versions,
)
from folioseek.operators.matching import term_keys
from folioseek.operators.postings import (
    FILE_COLUMNS,
    SAMPLED_ROWS,
    build_postings,
    clustered,
    count_terms,
    describe_files,
    document_lengths,
    field_counts,
    merge_term_counts,
    range_borders,
)
from folioseek.operators.scoring import without_superseded
from folioseek.schema import (
    COMMIT_SCHEMA,
    DOCUMENTS_TABLE,
    FIELD_STATS_SCHEMA,
    PATHS_SCHEMA,
    POSTINGS_SCHEMA,
    POSTINGS_TABLE,
    POSTING_FILES_SCHEMA,
    SUPERSEDED_SCHEMA,
    TERM_KEYS_SCHEMA,
    TERM_STATS_SCHEMA,
    TEXT_FIELDS,
)
from folioseek.sources.files import file_name
from folioseek.sources.records import stored_rows

INDEXED, QUARANTINED = "indexed", "quarantined"

# Text per term bucket that a batch's number of buckets aims at, and its least.
BUCKET_BYTES = 256 * 1024 * 1024
FEWEST_BUCKETS = 8

# Paths per bucket of a batch's paths.
BUCKET_PATHS = 1_000_000

# Text per postings file; a task sorts its postings, some 25 times as much, in memory.
POSTINGS_BYTES = 16 * 1024 * 1024

# Text per postings file that is cut into words to find where the file ends, and the
# text per posting that is expected in it.
SAMPLED_BYTES = 512 * 1024
TEXT_PER_POSTING = 10

# Rows about postings files that an open index remembers.
PLACES_KEPT = 10_000

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Batches with less text than this per task slot are spread over all slots.
SMALL_TASK_BYTES = 32 * 1024 * 1024


@dataclass(frozen=True)
class Batch:
    """What one indexing call did. `failed` holds its quarantined rows."""

    batch_id: int | None
    indexed: int
    quarantined: int
    failed: DataFrame


class DocumentIndex:
    """An index folder as of the moment it was opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = str(path).rstrip("/")
        self._places: dict[tuple[int, int], list[Row]] = {}
        # One small row per batch; `compact` keeps the live ones few.
        self._log = sorted(
            self._read("commits", COMMIT_SCHEMA, "json").collect(),
            key=lambda row: row["batch_id"],
        )

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        analyzer: str = "standard",
        term_buckets: int | None = None,
        near_keys: bool = False,
    ) -> "DocumentIndex":
        """Make the index if it is absent; otherwise leave it as it is.

        `near_keys` saves the deletion keys of all terms with each batch, for
        tables of many queries.
        """
        check_analyzer(analyzer)
        index = cls(spark, path)
        if not index.exists:
            index._commit(
                mode="create", analyzer=analyzer, term_buckets=term_buckets, near_keys=near_keys
            )
            index = cls(spark, path)
        return index

    # What is committed

    @property
    def exists(self) -> bool:
        return bool(self._log)

    @property
    def analyzer(self) -> str:
        return self._log[0]["analyzer"] if self._log else "standard"

    @cached_property
    def buckets_of(self) -> dict[int, int]:
        """Term buckets of each live batch: as asked for, else by its own text."""
        return {row["batch_id"]: row["term_buckets"] for row in self._live}

    @cached_property
    def _live(self) -> list[Row]:
        """Batches that count: those since the index was last overwritten."""
        live: list[Row] = []
        for row in self._log:
            if row["mode"] == "overwrite":
                live = []
            if row["mode"] != "create":
                live.append(row)
        return live

    @property
    def batches(self) -> list[int]:
        return [row["batch_id"] for row in self._live]

    def has_token(self, token: str) -> bool:
        return any(row["token"] == token for row in self._log)

    # Tables

    def document_versions(
        self, outcome: str = INDEXED, places: Iterable[tuple[int, int]] | None = None
    ) -> DataFrame:
        """Documents of all live batches, with the number of the file each lies in.

        With `places` (batch, file number) only those files are listed and opened.
        """
        batches, files = self.batches, ""
        if places is not None:
            batches = [batch for batch, _ in places]
            numbers = sorted({f"{number:05d}" for _, number in places})
            files = "/part-{" + ",".join(numbers) + "}-*"
        parts = f"batch_id={_any_of(batches)}/outcome={outcome}{files}"
        return _with_part(self._read("documents", DOCUMENTS_TABLE, parts=parts)).drop("outcome")

    def documents(self) -> DataFrame:
        """Current documents: one row per path, the latest batch wins."""
        return without_superseded(self.document_versions(), self.superseded())

    def _set_aside(self) -> DataFrame:
        """Rows whose latest record is a failure: one per path, and all without a path."""
        rows = self.document_versions(QUARANTINED)
        latest = latest_versions(rows.filter(F.col("file_path").isNotNull()))
        good = self.document_versions().select(
            F.col("file_path").alias("good_path"), F.col("batch_id").alias("good_batch")
        )
        later = (F.col("file_path") == F.col("good_path")) & (
            F.col("batch_id") < F.col("good_batch")
        )
        return latest.join(good, later, "left_anti").unionByName(
            rows.filter(F.col("file_path").isNull())
        )

    def quarantine(self) -> DataFrame:
        return self._set_aside().select(
            "file_path", "file_type", "file_size", "reason", "batch_id"
        )

    def known_files(self, failed: bool = True) -> DataFrame:
        """The latest record of each path, indexed or (if `failed`) set aside."""
        columns = ("file_path", "file_size", "modified_at", "content_hash")
        known = self.documents().select(*columns)
        return known.unionByName(self._set_aside().select(*columns)) if failed else known

    def posting_versions(self, places: Iterable[Row] | None = None) -> DataFrame:
        """Postings of all live batches, or of some of their files only.

        Files that are not named are not even listed.
        """
        if places is None:
            return _with_names(
                self._read("postings", POSTINGS_TABLE, parts=f"batch_id={_any_of(self.batches)}")
            )
        paths = {
            f"batch_id={row['batch_id']}/term_bucket={row['term_bucket']}/{row['file']}"
            for row in places
        }
        if not paths:
            return local_table(self.spark, [], POSTINGS_SCHEMA)
        return _with_names(self._read("postings", POSTINGS_TABLE, parts=sorted(paths)))

    def posting_places(self, hashes: Mapping[str, int]) -> list[Row]:
        """Files and fields that may hold one of these terms, given with their hashes.

        One row for each, of the terms' buckets only. The driver holds what a search
        opens; what it asked for last is remembered, up to PLACES_KEPT rows.
        """
        counts = set(self.buckets_of.values())
        wanted = {(count, number % count) for count in counts for number in hashes.values()}
        missing = wanted - set(self._places)
        found = {key: self._places.pop(key) for key in wanted - missing}
        found.update(self._places_in(missing))
        self._places.update(found)
        kept = sum(map(len, self._places.values()))
        while kept > PLACES_KEPT and len(self._places) > len(wanted):
            kept -= len(self._places.pop(next(iter(self._places))))
        terms = sorted(hashes)
        return [
            row
            for rows in found.values()
            for row in rows
            if _any_between(terms, row["first_term"], row["last_term"])
        ]

    def _places_in(self, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], list[Row]]:
        """Rows of `posting_files` for (number of buckets, bucket)."""
        if not wanted:
            return {}
        near = F.lit(False)
        for count in {count for count, _ in wanted}:
            batches = [batch for batch, own in self.buckets_of.items() if own == count]
            buckets = sorted(bucket for own, bucket in wanted if own == count)
            near |= F.col("batch_id").isin(batches) & F.col("term_bucket").isin(buckets)
        parts = f"batch_id={_any_of(self.batches)}"
        found = {key: [] for key in wanted}
        for row in self._read("posting_files", POSTING_FILES_SCHEMA, parts=parts).filter(near).collect():
            found[self.buckets_of[row["batch_id"]], row["term_bucket"]].append(row)
        return found

    def postings(self) -> DataFrame:
        return without_superseded(self.posting_versions(), self.superseded())

    def document_lengths(self) -> DataFrame:
        return document_lengths(self.postings())

    def superseded(self) -> DataFrame | None:
        """Replaced versions; None if nothing was ever replaced."""
        touched = [row["batch_id"] for row in self._live if row["superseded"]]
        if not touched:
            return None
        parts = f"batch_id={_any_of(touched)}"
        return self._read("superseded", SUPERSEDED_SCHEMA, parts=parts)

    def term_changes(self) -> DataFrame:
        """Signed term counts per batch; their sums are the current counts."""
        parts = f"batch_id={_any_of(self.batches)}"
        return self._read("term_stats", TERM_STATS_SCHEMA, parts=parts)

    def term_stats(self) -> DataFrame:
        counts = merge_term_counts(self.term_changes())
        return counts.select(
            "field", "term", "df", F.char_length("term").alias("term_len"), "cf"
        )

    def saved_term_keys(self) -> DataFrame | None:
        """Deletion keys of all terms; None if the index does not save them."""
        if not self._log or not self._log[0]["near_keys"]:
            return None
        parts = f"batch_id={_any_of(self.batches)}"
        return self._read("term_keys", TERM_KEYS_SCHEMA, parts=parts).drop("batch_id")

    def field_totals(self) -> DataFrame:
        """Documents, tokens and mean length per field, from a row per field and batch."""
        parts = f"batch_id={_any_of(self.batches)}"
        return (
            self._read("field_stats", FIELD_STATS_SCHEMA, parts=parts)
            .groupBy("field")
            .agg(F.sum("docs").alias("n"), F.sum("tokens").alias("tokens"))
            .filter("n > 0")
            .withColumn("avgdl", F.col("tokens") / F.col("n"))
        )

    @cached_property
    def field_stats(self) -> dict[str, Row]:
        return {row["field"]: row for row in self.field_totals().collect()}

    def per_field(self, name: str) -> dict[str, float]:
        """`n` or `avgdl` of every text field; 1 where a field has no terms."""
        found = {field: float(row[name]) for field, row in self.field_stats.items()}
        return {field: 1.0 for field in TEXT_FIELDS} | found

    def count_documents(self) -> int:
        return sum(row["indexed"] - row["superseded"] for row in self._live)

    # Writing

    def saved_work(self, rows: DataFrame) -> DataFrame:
        """Rows of a search, written where all executors reach them.

        Below spark.checkpoint.dir, or the index if that is unset; nothing else
        refers to them.
        """
        shared = self.spark.conf.get("spark.checkpoint.dir", None) or self.path
        folder = f"{shared.rstrip('/')}/_searches/{uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def append(
        self,
        documents: DataFrame,
        mode: str = "append",
        token: str | None = None,
        unique_paths: bool = False,
    ) -> Batch:
        """Write documents as one batch: rows with a known path replace it.

        `mode` is "append" or "overwrite" (the batch becomes the whole index). A
        `token` names the batch so that repeating the call does nothing.
        `unique_paths` skips the check for paths repeated inside the batch.
        """
        if mode not in ("append", "overwrite"):
            raise ValueError("mode must be 'append' or 'overwrite'")
        writer = DocumentIndex.create(self.spark, self.path)
        if token is not None and writer.has_token(token):
            return writer._nothing()
        rows = stored_rows(documents)
        if not unique_paths:
            rows = one_per_path(rows)
        with _shuffles_removed(self.spark):
            return writer._write(rows, mode, token)

    def compact(self) -> Batch:
        """Rewrite the current documents as a single batch."""
        return self.append(
            self.documents().drop("batch_id"), mode="overwrite", unique_paths=True
        )

    def _write(self, rows: DataFrame, mode: str, token: str | None) -> Batch:
        batch_id = self._log[-1]["batch_id"] + 1

        def saved(table: str, schema: T.StructType) -> DataFrame:
            parts = f"batch_id={_any_of([batch_id])}"
            return self._read(table, schema, parts=parts)

        def save(rows: DataFrame, table: str, *parts: str, **options: str) -> None:
            writer = rows.write.mode("overwrite").options(
                partitionOverwriteMode="static", **options
            )
            writer.partitionBy(*parts).parquet(self._batch_folder(table, batch_id))

        # One pass over the input writes good and bad rows. Sorting each task's
        # rows by path and a Bloom filter let a lookup skip nearly all files.
        outcome = F.when(F.col("reason").isNull(), INDEXED).otherwise(QUARANTINED)
        save(
            rows.withColumn("outcome", outcome).sortWithinPartitions("outcome", "file_path"),
            "documents",
            "outcome",
            **{
                "compression": "zstd",
                "parquet.bloom.filter.enabled#file_path": "true",
                "parquet.bloom.filter.adaptive.enabled": "true",
            },
        )
        written = saved("documents", DOCUMENTS_TABLE)
        # At most two rows: the outcomes.
        counts = {
            row["outcome"]: row
            for row in written.groupBy("outcome")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("file_size").alias("bytes"))
            .collect()
        }
        indexed = counts[INDEXED]["rows"] if INDEXED in counts else 0
        quarantined = counts[QUARANTINED]["rows"] if QUARANTINED in counts else 0
        if not indexed and not quarantined:
            return self._nothing()
        good = _with_part(written).filter(F.col("outcome") == INDEXED)
        text_bytes = (counts[INDEXED]["bytes"] if indexed else 0) or 0
        slots = self.spark.sparkContext.defaultParallelism
        few = text_bytes <= slots * SMALL_TASK_BYTES or len(good.inputFiles()) < slots
        spread = good.repartition(max(slots, text_bytes // SMALL_TASK_BYTES)) if few else good

        buckets = self._log[0]["term_buckets"] or max(FEWEST_BUCKETS, text_bytes // BUCKET_BYTES)
        # Building is narrow; this is its only shuffle. A batch in too few files to keep
        # the cluster busy is spread out first.
        named = F.coalesce(F.col("file_name") == file_name(F.col("file_path")), F.lit(False))
        built = build_postings(
            spread.withColumn("named_by_path", named),
            self.analyzer,
            keep=("file_path", *FILE_COLUMNS, "file_part", "named_by_path"),
        ).withColumn("file_name", F.when(~F.col("named_by_path"), F.col("file_name")))
        files = max(slots, text_bytes // POSTINGS_BYTES)
        borders = self._borders(good, buckets, files, text_bytes)
        save(clustered(built, buckets, borders), "postings", "term_bucket", compression="zstd")
        save(
            describe_files(saved("postings", POSTINGS_SCHEMA)).orderBy("term_bucket", "first_term"),
            "posting_files",
        )
        counted = count_terms(saved("postings", POSTINGS_SCHEMA))

        path_buckets = max(1, indexed // BUCKET_PATHS)
        save(
            good.select("file_path")
            .withColumn("path_bucket", path_bucket(F.col("file_path"), path_buckets))
            .hint("rebalance", "path_bucket")
            .sortWithinPartitions("path_bucket", "file_path"),
            "paths",
            "path_bucket",
        )
        replaced = 0
        if mode == "append" and self.batches and indexed:
            save(self._replaced_by(good), "superseded")
            gone = saved("superseded", SUPERSEDED_SCHEMA)
            replaced = gone.count()
            if replaced:
                # One row per batch at most: the batches that lose documents.
                hit = gone.select("old_batch_id").distinct().collect()
                touched = F.col("batch_id").isin([row["old_batch_id"] for row in hit])
                old = self.document_versions().filter(touched).join(
                    gone.select("file_path", F.col("old_batch_id").alias("batch_id")),
                    ["file_path", "batch_id"],
                    "left_semi",
                )
                taken = count_terms(build_postings(old, self.analyzer, keep=()), -1)
                counted = merge_term_counts(counted.unionByName(taken))
        save(
            # Folders by length, so that a search lists only the lengths it can reach.
            counted.withColumn("term_len", F.char_length("term"))
            .hint("rebalance", "field", "term_len")
            .sortWithinPartitions("field", "term_len", "term"),
            "term_stats",
            "field",
            "term_len",
        )
        if self._log[0]["near_keys"]:
            known = saved("term_stats", TERM_STATS_SCHEMA).filter("df > 0")
            save(
                term_keys(known.select("term").distinct())
                .hint("rebalance", "key_bucket")
                .sortWithinPartitions("key_bucket", "key"),
                "term_keys",
                "key_bucket",
            )
        save(field_counts(saved("term_stats", TERM_STATS_SCHEMA)).coalesce(1), "field_stats")
        self._commit(
            batch_id=batch_id,
            mode=mode,
            token=token,
            analyzer=self.analyzer,
            term_buckets=buckets,
            path_buckets=path_buckets,
            indexed=indexed,
            quarantined=quarantined,
            superseded=replaced,
        )
        after = DocumentIndex(self.spark, self.path)
        failed = after.quarantine().filter(F.col("batch_id") == batch_id)
        return Batch(batch_id, indexed, quarantined, failed)

    def _borders(
        self, good: DataFrame, buckets: int, files: int, text_bytes: int
    ) -> list[tuple]:
        """Borders of ranges of postings, from documents chosen by hashes of their paths."""
        every = max(1, text_bytes // (files * SAMPLED_BYTES))
        chosen = good.filter(F.pmod(F.xxhash64("file_path"), F.lit(every)) == 0)
        sample = build_postings(chosen, self.analyzer, keep=("file_path",))
        expected = max(1, text_bytes // every // TEXT_PER_POSTING)
        return range_borders(sample, buckets, files, min(1.0, files * SAMPLED_ROWS / expected))

    def _replaced_by(self, documents: DataFrame) -> DataFrame:
        """Current versions of these documents' paths; other buckets of paths are not listed."""
        batches_of: dict[int, list[int]] = {}
        for row in self._live:
            if row["indexed"]:
                batches_of.setdefault(row["path_buckets"], []).append(row["batch_id"])
        known = local_table(self.spark, [], PATHS_SCHEMA)
        for buckets, batches in batches_of.items():
            own = documents.select(path_bucket(F.col("file_path"), buckets).alias("bucket"))
            # At most a number for each bucket: one for a million paths.
            touched = [row["bucket"] for row in own.distinct().collect()]
            parts = f"batch_id={_any_of(batches)}/path_bucket={_any_of(touched)}"
            known = known.unionByName(self._read("paths", PATHS_SCHEMA, parts=parts))
        versions, gone = replaced_versions(documents, known), self.superseded()
        if gone is None:
            return versions
        return versions.join(
            gone.select("file_path", "old_batch_id"), ["file_path", "old_batch_id"], "left_anti"
        )

    def _nothing(self) -> Batch:
        return Batch(None, 0, 0, self.quarantine().limit(0))

    def _commit(self, **values) -> None:
        row = {"batch_id": 0, "indexed": 0, "quarantined": 0, "superseded": 0} | values
        columns = [
            F.lit(row.get(item.name)).cast(item.dataType).alias(item.name)
            for item in COMMIT_SCHEMA
        ]
        one = self.spark.range(1).select(*columns).coalesce(1)
        one.write.mode("append").json(f"{self.path}/commits")

    def _batch_folder(self, table: str, batch_id: int) -> str:
        return f"{self.path}/{table}/batch_id={batch_id}"

    def _read(
        self,
        table: str,
        schema: T.StructType,
        kind: str = "parquet",
        parts: str | list[str] = "",
    ) -> DataFrame:
        folder = f"{self.path}/{table}"
        reader = self.spark.read.format(kind).schema(schema).option("basePath", folder)
        try:
            if isinstance(parts, list):
                return reader.load([f"{folder}/{part}" for part in parts])
            return reader.load(f"{folder}/{parts}" if parts else folder)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return local_table(self.spark, [], schema)


def local_table(
    spark: SparkSession, rows: list[Row] | list[dict], schema: T.StructType
) -> DataFrame:
    """A few rows the driver holds, as a relation whose size Spark knows."""
    if not rows:
        return spark.createDataFrame([], schema)
    columns = {item.name: [row[item.name] for row in rows] for item in schema}
    return spark.createDataFrame(pa.table(columns)).select(
        *[F.col(item.name).cast(item.dataType) for item in schema]
    )


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let each step of an indexing call remove its shuffle files when it is done.

    Else they stay on disk until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def _with_part(documents: DataFrame) -> DataFrame:
    """Add the number in the name of the file that each row was read from."""
    if not documents.inputFiles():
        return documents.withColumn("file_part", F.lit(None).cast("int"))
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    return documents.withColumn("file_part", number.cast("int"))


def _with_names(postings: DataFrame) -> DataFrame:
    """Put in the file names that are not stored, as they are the last parts of paths."""
    name = F.when(F.col("named_by_path"), file_name(F.col("file_path")))
    return postings.withColumn(
        "file_name", name.otherwise(F.col("file_name"))
    ).drop("named_by_path")


def _any_between(values: list[str], least: str, most: str) -> bool:
    """Whether one of some sorted values lies in a range; compared as UTF-8, like Spark does."""
    low, high = least.encode(), most.encode()
    return any(low <= value.encode() <= high for value in values)


def _any_of(values: Iterable[int]) -> str:
    """Folder glob for some numbers; -1 matches none."""
    return "{" + ",".join(str(value) for value in sorted(set(values)) or [-1]) + "}"
