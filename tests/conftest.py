import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_index(spark, tmp_path_factory):
    """Index of (path, type, content[, more columns]) rows."""
    from folioseek import DocumentIndex, index_documents

    def build(rows, analyzer="standard"):
        folder = tmp_path_factory.mktemp("index")
        DocumentIndex.create(spark, str(folder), analyzer)
        index_documents(DocumentIndex(spark, str(folder)), as_documents(spark, rows))
        return DocumentIndex(spark, str(folder))

    return build


def as_documents(spark, rows):
    records = [
        (path.rsplit("/", 1)[-1], path, kind, content, len(content.encode()))
        for path, kind, content in rows
    ]
    return spark.createDataFrame(
        records,
        "file_name string, file_path string, file_type string, content string, file_size long",
    )
