"""Document indexing and ranked full-text search as Spark jobs over tables."""

from folioseek.plans.ingest import (
    count_files,
    index_changed_documents,
    index_documents,
    index_folder,
    index_new_files,
    process_folder,
)
from folioseek.plans.search import (
    advanced_search,
    bool_search,
    phrase_search,
    search_documents,
    search_many,
    summarize_hits,
    term_changes_over_time,
    term_trends,
)
from folioseek.plans.store import Batch, DocumentIndex
from folioseek.sources.records import documents_from_records
from folioseek.streaming.arrivals import index_arrivals

__all__ = [
    "Batch",
    "DocumentIndex",
    "advanced_search",
    "bool_search",
    "count_files",
    "documents_from_records",
    "index_arrivals",
    "index_changed_documents",
    "index_documents",
    "index_folder",
    "index_new_files",
    "phrase_search",
    "process_folder",
    "search_documents",
    "search_many",
    "summarize_hits",
    "term_changes_over_time",
    "term_trends",
]
