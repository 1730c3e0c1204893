"""Folder scans: which files there are, without reading them."""

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioseek.schema import FILE_TYPES
from folioseek.sources.folders import qualified
from folioseek.sources.omitted import omitted_files

# Largest file Spark's binary source loads into one row.
MAX_FILE_BYTES = 2_147_483_647

BINARY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# `omitted` rows are those that Spark's file source passes over; their contents are
# read later, from `stored_at`.
SCAN_SCHEMA = T.StructType(
    BINARY_SCHEMA.fields
    + [T.StructField("stored_at", T.StringType()), T.StructField("omitted", T.BooleanType())]
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_type(path: Column) -> Column:
    """Lower-case extension; a leading full stop does not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*\.([^.]*)$", 1))


def any_case_glob(types: tuple[str, ...] = FILE_TYPES) -> str:
    """Glob for names ending in one of the extensions in either case."""
    parts = ["".join(f"[{c}{c.upper()}]" for c in name) for name in types]
    return "*.{" + ",".join(parts) + "}"


def scan_folder(
    spark: SparkSession, folder: str, types: tuple[str, ...] = FILE_TYPES
) -> DataFrame:
    """Supported files below a folder, as `binaryFile` gives them; all files without `types`.

    A missing folder gives no rows. Columns not used later are never read, so
    selecting path, time and length lists files without opening them. Hidden and
    empty files and those in hidden folders, which that source passes over, come
    from a source of their own, `omitted` and with null contents.
    """
    folder = os.fspath(folder)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if types:
        reader = reader.option("pathGlobFilter", any_case_glob(types))
    try:
        plain = reader.load(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCAN_SCHEMA)
    omitted = omitted_files(spark, qualified(spark, folder), types)
    return plain.select("*", F.lit(None).cast("string").alias("stored_at"), F.lit(False).alias("omitted")).unionByName(
        omitted.select("*", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("omitted"))
    )


def file_records(files: DataFrame, *more: str) -> DataFrame:
    """Name, path, type, size and modification time of scanned files."""
    return files.select(
        file_name(F.col("path")).alias("file_name"),
        F.col("path").alias("file_path"),
        file_type(F.col("path")).alias("file_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
        *more,
    )
