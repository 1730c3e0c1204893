"""Text extraction on the executors, one file per row."""

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from folioseek.functions.decoders import Decoder, standard_decoders
from folioseek.schema import STORED_SCHEMA
from folioseek.sources.files import BINARY_SCHEMA, MAX_FILE_BYTES, file_records
from folioseek.sources.omitted import with_contents

# Old Word files are not readable; they are set aside, never indexed.
NO_DECODER = "no_extractor"
TOO_LARGE = "too_large"
EMPTY = "empty_content"
# A hidden file whose storage no task can open.
UNREADABLE = "unreadable"


def extract_documents(
    files: DataFrame,
    decoders: Mapping[str, Decoder] | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Scanned files with their text, or with the reason there is none.

    A file that fails never stops the others. The size bound is pushed to the
    file source, which then does not open larger files; those are listed with
    their reason instead. Files that the source passes over are opened only here,
    after the bound.
    """
    known = standard_decoders() | dict(decoders or {})
    small = files.filter(F.col("length") <= max_bytes)
    large = files.filter(F.col("length") > max_bytes)

    opened = small
    if "omitted" in files.columns:
        opened = small.filter("NOT omitted").select(*BINARY_SCHEMA.names).unionByName(
            with_contents(small.filter("omitted")).select(*BINARY_SCHEMA.names)
        )
    opened = file_records(opened, "content")
    records = [name for name in opened.columns if name != "content"]

    def decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                _decode(known.get(kind), data)
                for kind, data in zip(batch["file_type"], batch["content"])
            ]
            out = batch[records].copy()
            out["content"] = [row[0] for row in rows]
            out["metadata"] = [row[1] for row in rows]
            out["reason"] = [row[2] for row in rows]
            yield out

    schema = T.StructType(
        [STORED_SCHEMA[name] for name in records + ["content", "metadata", "reason"]]
    )
    extracted = opened.mapInPandas(decode_batches, schema)
    skipped = file_records(large).withColumn("reason", F.lit(TOO_LARGE))
    return extracted.unionByName(skipped, allowMissingColumns=True)


def _decode(decoder: Decoder | None, data: bytes | None) -> tuple:
    if decoder is None:
        return None, None, NO_DECODER
    if data is None:
        return None, None, UNREADABLE
    try:
        text, metadata = decoder(data)
    except Exception as problem:  # one bad file must not stop the batch
        return None, None, f"failed: {type(problem).__name__}: {problem}"
    return (text, metadata, None) if text else (None, metadata, EMPTY)
