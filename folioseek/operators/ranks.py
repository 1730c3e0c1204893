"""Places in an order that no task has to hold whole."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Bits of a row's number that count within its partition, as Spark numbers rows.
_LOCAL_BITS = 33


def with_places(
    rows: DataFrame, keys: list[str], order: list[Column], save: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """`rows` with their `place`, from 1, in the order within their keys.

    Rows are dealt out by ranges of key and order, so that a key with very many
    rows fills many partitions. They are numbered where they lie and written by
    `save`, which fixes the ranges; a row's place is that within its partition and
    the rows of its key in the partitions before, of which there is one number for
    each key and partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key) for key in keys]
    numbered = save(
        rows.repartitionByRange(parts, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_number", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_number", _LOCAL_BITS))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        numbered.groupBy(*keys, "_part")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_number").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    place = F.col("_before") + F.col("_number") - F.col("_first") + 1
    return numbered.join(spans, [*keys, "_part"]).withColumn("place", place).select(*rows.columns, "place")
