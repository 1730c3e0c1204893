"""Which rows are new, changed or the latest."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_versions(documents: DataFrame) -> DataFrame:
    """One row per path from a log that may hold older batches of it.

    The row limit is applied in each task before the shuffle, so a path with
    very many versions does not gather in one task.
    """
    newest = Window.partitionBy("file_path").orderBy(F.desc("batch_id"))
    return (
        documents.withColumn("_place", F.row_number().over(newest))
        .filter("_place = 1")
        .drop("_place")
    )


def one_per_path(documents: DataFrame) -> DataFrame:
    """Settle repeated paths inside one batch: newest, then a fixed choice.

    Rows without a path are all kept.
    """
    alone = F.when(F.col("file_path").isNull(), F.monotonically_increasing_id())
    choice = Window.partitionBy("file_path", "_alone").orderBy(
        F.desc_nulls_last("modified_at"), F.desc_nulls_last("content_hash")
    )
    return (
        documents.withColumn("_alone", alone)
        .withColumn("_place", F.row_number().over(choice))
        .filter("_place = 1")
        .drop("_alone", "_place")
    )


def new_or_changed(documents: DataFrame, current: DataFrame) -> DataFrame:
    """Documents whose path is unknown or whose content differs."""
    known = current.select(
        F.col("file_path").alias("known_path"), F.col("content_hash").alias("known_hash")
    )
    same = (F.col("file_path") == F.col("known_path")) & F.col("content_hash").eqNullSafe(
        F.col("known_hash")
    )
    return documents.join(known, same, "left_anti")


def new_or_modified_files(files: DataFrame, current: DataFrame) -> DataFrame:
    """Scanned files whose path, size and modification time are not all known.

    Neither side reads any content.
    """
    known = current.select("file_path", "file_size", "modified_at")
    return files.select("file_path", "file_size", "modified_at").join(
        known, ["file_path", "file_size", "modified_at"], "left_anti"
    )


def path_bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def replaced_versions(new_paths: DataFrame, current: DataFrame) -> DataFrame:
    """Current versions that a new batch with these paths replaces."""
    return current.select("file_path", F.col("batch_id").alias("old_batch_id")).join(
        new_paths.select("file_path"), "file_path", "left_semi"
    )
