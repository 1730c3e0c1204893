"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space: the bytes 0x09-0x0D and 0x20.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = "[ \\t\\n\\x0B\\f\\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors reach: spark.checkpoint.dir, else below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage, and what was computed survives the loss of executors.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Most rows of a counted table that a join broadcasts; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def small_side(table: DataFrame) -> DataFrame:
    """A saved table for a join: broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def split_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; none for null and blank texts."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_RE)).otherwise(
        F.array().cast("array<string>")
    )


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
