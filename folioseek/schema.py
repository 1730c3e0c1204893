"""Table layouts and the fixed values of the search contract."""

from pyspark.sql import types as T

# File extensions taken in by a folder scan.
FILE_TYPES = ("docx", "xlsx", "xls", "pdf", "csv", "doc")

# Fields that text is matched against, and the ranking constants.
TEXT_FIELDS = ("content", "file_name")
BM25_K1 = 1.2
BM25_B = 0.75
SCORE_DIGITS = 6
DEFAULT_SIZE = 10

# Longest exact-value sort keys.
NAME_KEY_LENGTH = 256
PATH_KEY_LENGTH = 512

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("file_size", T.LongType()),
    ]
)

# A document as it is stored: the five record fields, the optional ones, and
# why the row was set aside if it was (`reason` is null for a good row).
STORED_SCHEMA = T.StructType(
    DOCUMENT_SCHEMA.fields
    + [
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_hash", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

DOCUMENTS_TABLE = T.StructType(
    STORED_SCHEMA.fields
    + [
        T.StructField("batch_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
    ]
)

# `is_lead` marks one posting per document and field, so that documents can be
# counted by adding up. The file columns repeat the document's own values: a
# search filters and sorts on them without joining the documents table. `file_part`
# numbers the documents file of the batch that holds the text.
POSTINGS_SCHEMA = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("tf", T.LongType()),
        T.StructField("dl", T.LongType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("is_lead", T.BooleanType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("file_part", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("term_bucket", T.IntegerType()),
    ]
)

# How postings are stored: without the file name where it is the last part of the path.
POSTINGS_TABLE = T.StructType(
    POSTINGS_SCHEMA.fields + [T.StructField("named_by_path", T.BooleanType())]
)

# What each postings file holds of a field: its first and last term, and what bounds
# the weight of its postings from above.
POSTING_FILES_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("first_term", T.StringType()),
        T.StructField("last_term", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("most_tf", T.LongType()),
        T.StructField("least_ratio", T.DoubleType()),
        T.StructField("term_bucket", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# Signed changes per batch: a replaced document takes its counts back out.
TERM_STATS_SCHEMA = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("term_len", T.IntegerType()),
        T.StructField("df", T.LongType()),
        T.StructField("cf", T.LongType()),
        T.StructField("docs", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

FIELD_STATS_SCHEMA = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("docs", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# The paths of a batch, by hash: what a later batch looks its own up in.
PATHS_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("path_bucket", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# Deletion keys of a batch's terms, if the index saves them.
TERM_KEYS_SCHEMA = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("key_bucket", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

# Document versions that a later batch replaced; `batch_id` is the replacing one.
SUPERSEDED_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("old_batch_id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

COMMIT_SCHEMA = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("mode", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("analyzer", T.StringType()),
        T.StructField("term_buckets", T.IntegerType()),
        T.StructField("path_buckets", T.IntegerType()),
        T.StructField("near_keys", T.BooleanType()),
        T.StructField("indexed", T.LongType()),
        T.StructField("quarantined", T.LongType()),
        T.StructField("superseded", T.LongType()),
    ]
)

HIT_COLUMNS = (
    "file_name",
    "file_path",
    "file_type",
    "content",
    "file_size",
    "created_at",
    "modified_at",
    "metadata",
)
