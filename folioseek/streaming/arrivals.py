"""Files arriving in a folder, as a Structured Streaming job."""

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioseek.functions.decoders import Decoder
from folioseek.plans.store import DocumentIndex
from folioseek.schema import FILE_TYPES
from folioseek.sources.extraction import extract_documents
from folioseek.sources.files import BINARY_SCHEMA, any_case_glob
from folioseek.sources.folders import qualified
from folioseek.sources.omitted import omitted_arrivals


def index_arrivals(
    index: DocumentIndex,
    folder: str,
    checkpoint: str,
    name: str = "arrivals",
    files_per_batch: int | None = None,
    decoders: Mapping[str, Decoder] | None = None,
) -> StreamingQuery:
    """Index files not seen before, then stop.

    Each micro-batch is committed under its stream name and number, so a batch
    that is replayed after a failure is indexed once. The file source remembers
    paths: changed files need `index_new_files`. Hidden and empty files, which that
    source passes over, arrive by their time of modification; one that is moved in
    with an older time is found by `index_new_files`.
    """
    reader = (
        index.spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", any_case_glob(FILE_TYPES))
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(files: DataFrame, epoch: int) -> None:
        documents = extract_documents(files, decoders)
        index.append(documents, token=f"{name}:{epoch}", unique_paths=True)

    plain = reader.load(os.fspath(folder))
    arrivals = plain.select(
        "*", F.lit(None).cast("string").alias("stored_at"), F.lit(False).alias("omitted")
    )
    omitted = omitted_arrivals(index.spark, qualified(index.spark, os.fspath(folder)), FILE_TYPES)
    if omitted is not None:
        arrivals = arrivals.unionByName(
            omitted.select("*", F.lit(None).cast("binary").alias("content"), F.lit(True).alias("omitted"))
        )
    return (
        arrivals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .queryName(name)
        .start()
    )
