"""Documents given as rows or as a DataFrame."""

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.schema import DOCUMENT_SCHEMA, STORED_SCHEMA


def documents_from_records(
    spark: SparkSession, records: Iterable[Mapping[str, object]]
) -> DataFrame:
    """Record dicts as a DataFrame; no records give an empty typed one."""
    names = DOCUMENT_SCHEMA.fieldNames()
    rows = [tuple(record.get(name) for name in names) for record in records]
    return spark.createDataFrame(rows, DOCUMENT_SCHEMA)


def stored_rows(documents: DataFrame) -> DataFrame:
    """Bring documents to the stored layout and say which rows are bad.

    Missing optional columns become null. A row without a path or without text
    gets a reason; text of blanks only is kept.
    """
    present = set(documents.columns)
    columns = {}
    for item in STORED_SCHEMA:
        value = F.col(item.name) if item.name in present else F.lit(None)
        columns[item.name] = value.cast(item.dataType)
    if "content_hash" not in present:
        columns["content_hash"] = F.sha2(columns["content"], 256)
    given = columns["reason"]
    content = columns["content"]
    columns["reason"] = (
        F.when(given.isNotNull(), given)
        .when(columns["file_path"].isNull(), F.lit("missing_path"))
        .when(content.isNull() | (content == ""), F.lit("empty_content"))
    )
    return documents.select(*[columns[n].alias(n) for n in STORED_SCHEMA.fieldNames()])
