"""One way to list folders, whatever storage they lie in.

Paths are written as Spark writes them. Storage that Arrow knows is listed and
read by tasks, with the credentials of Spark's Hadoop configuration; any other
is listed through Hadoop's own file system, which only the driver's JVM has.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

# Options of Hadoop's S3 client, and what Arrow's calls them.
S3_OPTIONS = {
    "access.key": "access_key",
    "secret.key": "secret_key",
    "session.token": "session_token",
    "endpoint": "endpoint_override",
    "endpoint.region": "region",
}
S3_SCHEMES = ("s3", "s3a", "s3n")
S3_PREFIX = "fs.s3a."


@dataclass(frozen=True)
class Listed:
    """One name of a folder."""

    path: str
    is_folder: bool
    length: int
    modified: datetime | None

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's whole address, as Spark's default file system completes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def storage_settings(spark: SparkSession) -> dict[str, str]:
    """Credentials and endpoints of S3 in Spark's configuration, general and of single buckets."""
    found = spark._jsc.hadoopConfiguration().getPropsWithPrefix(S3_PREFIX)
    return {S3_PREFIX + key: found[key] for key in found if key.endswith(tuple(S3_OPTIONS)) and found[key]}


def _parts(address: str) -> tuple[str, str, str]:
    """Scheme, authority and path of an address such as `file:/a` or `s3a://bucket/a`."""
    scheme, _, rest = address.partition(":")
    if not rest.startswith("//"):
        return scheme, "", rest
    authority, _, path = rest[2:].partition("/")
    return scheme, authority, "/" + path


def storage_of(address: str) -> str:
    """Scheme and authority, which every path of a storage begins with."""
    scheme, authority, _ = _parts(address)
    return f"{scheme}://{authority}" if authority else f"{scheme}:"


@lru_cache(maxsize=64)
def _system(root: str, settings: tuple[tuple[str, str], ...]) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for the root of some storage, and its name of that root."""
    scheme, authority, _ = _parts(root)
    if scheme == "file":
        return fs.LocalFileSystem(), ""
    if scheme in S3_SCHEMES:
        known = dict(settings)
        given = {}
        for key, name in S3_OPTIONS.items():
            # A bucket's own settings go first.
            value = known.get(f"{S3_PREFIX}bucket.{authority}.{key}", known.get(S3_PREFIX + key))
            if value:
                given[name] = value
        if given.get("endpoint_override", "").startswith("http://"):
            given["scheme"] = "http"
        return fs.S3FileSystem(**given), authority
    system, path = fs.FileSystem.from_uri(root + "/")
    return system, path.rstrip("/")


@dataclass(frozen=True)
class ArrowFolder:
    """Folders of a storage that Arrow knows; sent to tasks."""

    address: str
    settings: Mapping[str, str]

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        """The file system of a path, and its name of it."""
        root = storage_of(path)
        system, own = _system(root, tuple(sorted(self.settings.items())))
        return system, own + path.removeprefix(root)

    def listed(self, folder: str) -> list[Listed]:
        system, own = self._open(folder)
        start = len(own.rstrip("/"))
        return [
            Listed(
                folder.rstrip("/") + info.path[start:],
                info.type == fs.FileType.Directory,
                info.size or 0,
                info.mtime,
            )
            for info in system.get_file_info(fs.FileSelector(own, allow_not_found=True))
        ]

    def read(self, path: str) -> bytes:
        system, own = self._open(path)
        with system.open_input_stream(own) as stream:
            return stream.read()


def arrow_folder(spark: SparkSession, address: str) -> ArrowFolder | None:
    """None for storage that Arrow does not know, or has no library for."""
    folder = ArrowFolder(address, storage_settings(spark))
    try:
        folder._open(address)
    except (pa.ArrowException, OSError, ImportError, AttributeError):
        return None
    return folder


class HadoopFolder:
    """Folders of any storage that Hadoop knows, listed by the driver."""

    def __init__(self, spark: SparkSession, address: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(address).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> Iterator[Listed]:
        path = self._path(folder)
        if not self._system.exists(path):
            return
        for status in self._system.listStatus(path):
            seconds = status.getModificationTime() / 1000
            yield Listed(
                status.getPath().toString(),
                status.isDirectory(),
                status.getLen(),
                datetime.fromtimestamp(seconds, timezone.utc),
            )

    def stored_at(self, path: str) -> str:
        """Where a path of a storage that maps others really lies."""
        return self._system.resolvePath(self._path(path)).toString()
