"""Files that Spark's file sources pass over: hidden names, all below hidden folders, and empty files.

They are listed here without being opened; contents are read in a later step,
for those rows only that still need them.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from folioseek.sources.folders import (
    ArrowFolder,
    HadoopFolder,
    Listed,
    arrow_folder,
    storage_of,
    storage_settings,
)

# Folders that the driver finds, at least, before tasks walk what is below them.
FOLDERS = 1000

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# `stored_at` is where tasks can read the file; null if none can.
SCHEMA = "path string, modificationTime timestamp, length bigint, stored_at string"
CONTENTS = f"{SCHEMA}, content binary"


def is_hidden(name: str) -> bool:
    """Whether Spark takes no file of this name: a leading `.`, or `_` without `=`, or a copy under way."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def is_hidden_folder(name: str) -> bool:
    """Whether Spark does not walk a folder of this name; names of Parquet's metadata it does."""
    return is_hidden(name) and not name.startswith(("_metadata", "_common_metadata"))


def _below(found: Iterable[Listed], hidden: bool) -> list[tuple[str, bool]]:
    """The folders among `found`, and whether Spark passes over what is in them."""
    return [(x.path, hidden or is_hidden_folder(x.name)) for x in found if x.is_folder]


def _wanted(x: Listed, hidden: bool, types: tuple[str, ...]) -> bool:
    if x.is_folder or not (hidden or x.length == 0 or is_hidden(x.name)):
        return False
    return not types or any(fnmatchcase(x.name.lower(), f"*.{t}") for t in types)


def walked(
    lister: ArrowFolder | HadoopFolder, folders: Iterable[tuple[str, bool, bool]], types: tuple[str, ...]
) -> Iterator[Listed]:
    """Omitted files of (folder, hidden, whether its own folders are walked too)."""
    waiting = list(folders)
    while waiting:
        folder, hidden, deeper = waiting.pop()
        found = list(lister.listed(folder))
        yield from (x for x in found if _wanted(x, hidden, types))
        if deeper:
            waiting.extend((*below, True) for below in _below(found, hidden))


class OmittedFiles(DataSource):
    """Path, time and length of omitted files below `path` whose type is among `types` (all if empty).

    The driver goes through the uppermost folders only; tasks walk the others.
    Other options are those of the storage.
    """

    @classmethod
    def name(cls) -> str:
        return "omitted_files"

    def schema(self) -> str:
        return SCHEMA

    def _asked(self) -> tuple[ArrowFolder, tuple[str, ...]]:
        settings = {k: v for k, v in self.options.items() if k.startswith("fs.")}
        return ArrowFolder(self.options["path"], settings), tuple(json.loads(self.options["types"]))

    def reader(self, schema) -> OmittedReader:
        return OmittedReader(*self._asked())

    def streamReader(self, schema) -> OmittedArrivals:
        return OmittedArrivals(*self._asked())


def _dealt_out(lister: ArrowFolder) -> list[list[tuple[str, bool, bool]]]:
    """Lists of (folder, hidden, whether its own folders are walked too), one for each task."""
    seen, waiting = [], deque([(lister.address, False)])
    while waiting and len(waiting) < FOLDERS:
        folder, hidden = waiting.popleft()
        seen.append((folder, hidden, False))
        waiting.extend(_below(lister.listed(folder), hidden))
    found = seen + [(folder, hidden, True) for folder, hidden in waiting]
    step = len(found) // FOLDERS + 1
    return [found[a : a + step] for a in range(0, len(found), step)]


class OmittedArrivals(DataSourceStreamReader):
    """Omitted files by the time they were modified, in microseconds; that time is the offset.

    A batch holds the files after its start up to its end, however often it is run.
    """

    def __init__(self, folder: ArrowFolder, types: tuple[str, ...]):
        self.folder, self.types = folder, types

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition((start["until"], end["until"], part)) for part in _dealt_out(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end, folders = partition.value
        for x in walked(self.folder, folders, self.types):
            if start < (x.modified - EPOCH) // timedelta(microseconds=1) <= end:
                yield x.path, x.modified, x.length, x.path


class OmittedReader(DataSourceReader):
    def __init__(self, folder: ArrowFolder, types: tuple[str, ...]):
        self.folder, self.types = folder, types

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(part) for part in _dealt_out(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for x in walked(self.folder, partition.value, self.types):
            yield x.path, x.modified, x.length, x.path


def omitted_files(spark: SparkSession, address: str, types: tuple[str, ...] = ()) -> DataFrame:
    """Omitted files below a whole address, unopened.

    Storage that only Hadoop knows is listed by the driver; its hidden files can be
    read if they are stored where Arrow reaches them.
    """
    known = arrow_folder(spark, address)
    if known is not None:
        spark.dataSource.register(OmittedFiles)
        reader = spark.read.format("omitted_files").option("types", json.dumps(types))
        return reader.options(**known.settings).load(address)
    lister, rows, reached = HadoopFolder(spark, address), [], {}
    for x in walked(lister, [(address, False, True)], types):
        stored = lister.stored_at(x.path)
        storage = storage_of(stored)
        if storage not in reached:
            reached[storage] = arrow_folder(spark, stored) is not None
        rows.append((x.path, x.modified, x.length, stored if reached[storage] else None))
    return spark.createDataFrame(rows, SCHEMA)


def omitted_arrivals(spark: SparkSession, address: str, types: tuple[str, ...]) -> DataFrame | None:
    """Omitted files as a stream; None for storage that only Hadoop knows."""
    known = arrow_folder(spark, address)
    if known is None:
        return None
    spark.dataSource.register(OmittedFiles)
    reader = spark.readStream.format("omitted_files").option("types", json.dumps(types))
    return reader.options(**known.settings).load(address)


def with_contents(files: DataFrame) -> DataFrame:
    """Omitted files with their contents, null for one that cannot be read; dealt out evenly."""
    spark = files.sparkSession
    storage = ArrowFolder("", storage_settings(spark))

    def content(stored_at: str | None, length: int) -> bytes | None:
        if not length:
            return b""
        try:
            return stored_at and storage.read(stored_at)
        except OSError:  # one bad file must not stop the batch
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = content(row.column("stored_at")[0].as_py(), row.column("length")[0].as_py())
                columns = [*row.columns, pa.array([found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*row.schema.names, "content"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = files.select("path", "modificationTime", "length", "stored_at").repartition(parts)
    return listed.mapInArrow(run, CONTENTS)
