"""

Searches run over an index of the whole `documents` table, built once per
session and data folder below `spark.checkpoint.dir`. Each query reads the
given tables or that index.
"""

from __future__ import annotations

import importlib
import importlib.util
import sys
from collections.abc import Callable
from pathlib import Path
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioseek import (  # noqa: E402
    DocumentIndex,
    advanced_search,
    bool_search,
    index_documents,
    phrase_search,
    search_documents,
    search_many,
    summarize_hits,
    term_changes_over_time,
    term_trends,
)
from folioseek.functions.display import summary_lines
from folioseek.functions.text import normalize_text
from folioseek.operators.changes import new_or_changed
from folioseek.operators.postings import sort_keys
from folioseek.operators.trends import scan_counters
from folioseek.sources.files import file_name, file_type
from folioseek.sources.records import stored_rows
from oracle import oracle_queries

Query = Callable[[SparkSession, str], DataFrame]

# Searches whose whole result is compared set no limit.
ALL = None

_indexes: dict[tuple[str, str], DocumentIndex] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as files of this library's model."""
    path = F.concat_ws("", F.lit("/"), "source", F.lit("/doc_"), "doc_id", F.lit("."), "lang")
    hours = 1_704_067_200 + F.col("doc_id") * 3600
    return (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .withColumn("file_path", path)
        .select(
            file_name(F.col("file_path")).alias("file_name"),
            "file_path",
            file_type(F.col("file_path")).alias("file_type"),
            F.col("text").alias("content"),
            F.octet_length("text").cast("long").alias("file_size"),
            F.timestamp_seconds(hours).alias("modified_at"),
            F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
        )
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: spark.checkpoint.dir, else below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_indexes"


def saved_index(
    spark: SparkSession, sf_dir: str, name: str = "plain", analyzer: str = "standard"
) -> DocumentIndex:
    """The index of a data folder, built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        place = f"folioseek-{key[0]}/{crc32(sf_dir.encode()):08x}-{name}"
        path = f"{shared_folder(spark).rstrip('/')}/{place}"
        index = DocumentIndex.create(spark, path, analyzer)
        if not index.batches and name == "gaps":
            index_documents(index, scan_with_gaps(spark, sf_dir), unique_paths=True)
        elif not index.batches:
            index_documents(index, documents(spark, sf_dir), unique_paths=True)
        if name == "updated":
            index_documents(DocumentIndex(spark, path), repeated_scan(spark, sf_dir))
        _indexes[key] = DocumentIndex(spark, path)
    return _indexes[key]


def second_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later scan of all English files: longer, with a new closing line."""
    return (
        documents(spark, sf_dir)
        .filter("file_type = 'en'")
        .withColumn("content", F.concat("content", F.lit("\nRevised edition.")))
        .withColumn("file_size", F.col("file_size") + 17)
    )


def repeated_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later scan with an older state of every file in it; the newer one counts."""
    scan = second_scan(spark, sf_dir)
    stale = scan.withColumn("content", F.lit("stale")).withColumn(
        "modified_at", F.expr("modified_at - INTERVAL 1 DAY")
    )
    return stale.unionByName(scan)


def scan_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that misses the French files and gets no text from the Spanish ones."""
    return (
        documents(spark, sf_dir)
        .filter("file_type <> 'fr'")
        .withColumn("content", F.expr("if(file_type = 'es', NULL, content)"))
    )


def watch_list(spark: SparkSession) -> DataFrame:
    """The fixed queries of the many-queries search."""
    return spark.sql(
        "SELECT * FROM VALUES (1, 'the'), (2, 'thereou quene'), (3, 'réaution'), "
        "(4, 'doc_12.en') AS q (query_id, query_text)"
    )


def _scores(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("file_path", "file_type", "file_size", "score", *more)


def _on_documents(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(documents(spark, sf_dir))


def _on_index(
    build: Callable[[DocumentIndex], DataFrame], name: str = "plain", analyzer: str = "standard"
) -> Query:
    return lambda spark, sf_dir: build(saved_index(spark, sf_dir, name, analyzer))


def _epoch(rows: DataFrame) -> DataFrame:
    return rows.select(
        "file_path", F.unix_seconds("modified_at").alias("modified_epoch"), "score"
    )


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a full scan: new (French) and changed (English) files, not failed or known ones."""
    scan = scan_with_gaps(spark, sf_dir).filter("file_type <> 'en'")
    scan = scan.unionByName(documents(spark, sf_dir).filter("file_type = 'fr'"))
    scan = stored_rows(scan.unionByName(second_scan(spark, sf_dir)))
    known = saved_index(spark, sf_dir, "gaps").known_files()
    return new_or_changed(scan, known).select("file_path", "file_size")


def _index_counts(index: DocumentIndex) -> DataFrame:
    """Rows that an indexing call took in and set aside, from the tables it wrote."""
    outcomes = index.documents().select(F.lit(True).alias("good")).unionByName(
        index.quarantine().select(F.lit(False).alias("good"))
    )
    return outcomes.agg(
        F.count_if("good").alias("indexed"), F.count_if(~F.col("good")).alias("quarantined")
    )


def _field_stats(index: DocumentIndex) -> DataFrame:
    return index.field_totals().select(
        "field", "n", "tokens", F.round("avgdl", 6).alias("avgdl")
    )


def _marked_hits(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(
        *more, "file_path", F.array_join("highlights", "|").alias("highlights")
    )


def _hit_summary(documents: DataFrame) -> DataFrame:
    lines = summary_lines("split(content, '\\n')")
    return documents.select("file_path", F.expr(f"array_join({lines}, '|')").alias("summary"))


def _next_page(index: DocumentIndex) -> DataFrame:
    """The hits that follow the first page's last one."""
    last = search_documents(index, "the thereou", 7).select("score", "file_path").tail(1)
    return _scores(search_documents(index, "the thereou", 7, after=tuple(last[0])))


def queries() -> dict[str, Query]:
    """One entry per operator of the survey's inventory."""
    found: dict[str, Query] = {
        "document_records": _on_documents(
            lambda d: d.select("file_name", "file_path", "file_type", "content", "file_size")
        ),
        "normalized_text": _on_documents(
            lambda d: d.select("file_path", F.expr(normalize_text("content")).alias("content"))
        ),
        "scan_summary": _on_documents(lambda d: scan_counters(stored_rows(d))),
        "index_counts": _on_index(_index_counts, "gaps"),
        "upsert_latest": _on_index(
            lambda i: i.documents().select("file_path", "content", "file_size", "batch_id"),
            "updated",
        ),
        "incremental_new_or_changed": _incremental,
        "postings": _on_index(
            lambda i: i.postings().select(
                "field",
                "term",
                "file_path",
                "tf",
                "dl",
                F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
            )
        ),
        "term_stats": _on_index(lambda i: i.term_stats()),
        "term_stats_updated": _on_index(lambda i: i.term_stats(), "updated"),
        "doc_stats": _on_index(lambda i: i.document_lengths().select("file_path", "field", "dl")),
        "field_stats": _on_index(_field_stats),
        "keyword_sort_keys": _on_documents(sort_keys),
        "index_count": _on_index(
            lambda i: i.documents().agg(F.count(F.lit(1)).alias("documents"))
        ),
        "index_count_updated": _on_index(
            lambda i: i.documents().agg(
                F.count(F.lit(1)).alias("documents"), F.sum("file_size").alias("bytes")
            ),
            "updated",
        ),
        "search_exact": _on_index(
            lambda i: _scores(search_documents(i, "the réaution", ALL, fuzziness=0))
        ),
        "search_fuzzy": _on_index(
            lambda i: _scores(search_documents(i, "thereou quene réaution", ALL))
        ),
        "search_basic": _on_index(
            lambda i: _scores(search_documents(i, "The thereou, quene!"), "content")
        ),
        "search_file_name": _on_index(lambda i: _scores(search_documents(i, "doc_12.en", ALL))),
        "search_updated": _on_index(
            lambda i: _scores(search_documents(i, "revised thereou", ALL)), "updated"
        ),
        "filter_type": _on_index(lambda i: _scores(advanced_search(i, file_type="fr", size=ALL))),
        "filter_size_range": _on_index(
            lambda i: _scores(advanced_search(i, min_size=1000, max_size=5000, size=ALL))
        ),
        "match_all": _on_index(lambda i: _scores(advanced_search(i, size=ALL))),
        "text_with_filters": _on_index(
            lambda i: _scores(
                advanced_search(
                    i, "thereou quene", file_type="en", min_size=1000, max_size=5000, size=ALL
                )
            )
        ),
        "sort_score": _on_index(
            lambda i: _scores(advanced_search(i, "thereou", sort_order="asc", size=20))
        ),
        "sort_name_desc": _on_index(
            lambda i: _scores(
                advanced_search(
                    i, "thereou", "en", 1000, sort_by="file_name", sort_order="desc"
                )
            )
        ),
        "sort_size_asc": _on_index(
            lambda i: _scores(
                advanced_search(i, min_size=1000, sort_by="file_size", sort_order="asc")
            )
        ),
        "top_k": _on_index(lambda i: _scores(search_documents(i, "quene", 3))),
        "unscored_hits": _on_index(
            lambda i: _scores(
                advanced_search(i, "réaution", sort_by="file_size", size=ALL), "content"
            )
        ),
        "fuzzy_limited": _on_index(
            lambda i: _scores(
                search_documents(i, "thereou quene réaution", ALL, max_expansions=5)
            )
        ),
        "metadata_filter": _on_index(
            lambda i: _scores(
                advanced_search(i, "the thereou", metadata={"source": "src7"}, size=ALL)
            )
        ),
        "sort_path": _on_index(
            lambda i: _scores(
                advanced_search(i, "quene", sort_by="file_path", sort_order="desc", size=20)
            )
        ),
        "highlights": _on_index(
            lambda i: _marked_hits(search_documents(i, "thereou réaution", ALL))
        ),
        "all_highlights": _on_index(
            lambda i: _marked_hits(
                search_documents(i, "thereou réaution", ALL, max_highlights=None)
            )
        ),
        "hit_projection": _on_index(
            lambda i: _marked_hits(
                search_documents(i, "thereou réaution", ALL),
                "file_name", "file_type", "content", "file_size", "score",
            )
        ),
        "hit_summary": _on_documents(_hit_summary),
        "search_summary": _on_index(
            lambda i: summarize_hits(search_documents(i, "thereou réaution", ALL)).select(
                "file_path", F.array_join("summary", "|").alias("summary")
            )
        ),
        "advanced_search": _on_index(
            lambda i: _scores(
                advanced_search(
                    i,
                    "the thereou",
                    file_type="en",
                    min_size=1000,
                    max_size=5000,
                    sort_by="file_size",
                    sort_order="desc",
                    size=25,
                ),
                "file_name",
                "content",
            )
        ),
        "bool_search": _on_index(
            lambda i: _scores(bool_search(i, ["the", "of"], ["reound"], ["and"], ALL))
        ),
        "phrase_search": _on_index(lambda i: _scores(phrase_search(i, "of the", size=ALL))),
        "phrase_of_three": _on_index(
            lambda i: _scores(phrase_search(i, "attion to thanedble", size=ALL))
        ),
        "phrase_repeated": _on_index(lambda i: _scores(phrase_search(i, "the the", size=ALL))),
        "fixed_fuzziness": _on_index(
            lambda i: _scores(search_documents(i, "thereou quene", ALL, fuzziness=1))
        ),
        "date_range": _on_index(
            lambda i: _epoch(
                advanced_search(
                    i,
                    modified_from="2024-01-05T00:00:00Z",
                    modified_to="2024-01-20T12:00:00Z",
                    size=ALL,
                )
            )
        ),
        "sort_modified": _on_index(
            lambda i: _epoch(advanced_search(i, "quene", sort_by="modified_at", size=15))
        ),
        "page_two": _on_index(
            lambda i: _scores(search_documents(i, "the thereou", page=2, page_size=7))
        ),
        "page_after_hit": _on_index(_next_page),
        "folded_text_search": _on_index(
            lambda i: _scores(search_documents(i, "REAUTION mais reounds", ALL, fuzziness=0)),
            "pt",
            "pt",
        ),
        "search_many": lambda spark, sf_dir: _marked_hits(
            search_many(saved_index(spark, sf_dir), watch_list(spark), 25),
            "query_id", "place", "score",
        ),
        "search_many_all": lambda spark, sf_dir: search_many(
            saved_index(spark, sf_dir), watch_list(spark), ALL
        ).select("query_id", "place", "file_path", "score"),
        "term_trends": _on_index(lambda i: term_trends(i)),
        "term_changes_over_time": _on_index(
            lambda i: term_changes_over_time(i).select(
                F.unix_seconds("period").alias("period_epoch"),
                "place", "term", "df", "docs", "df_before", "docs_before", "change",
            )
        ),
    }
    for module in _training_data_modules():
        found.update({name: _importable(query) for name, query in module.QUERIES.items()})
    return found


def _importable(query: Query) -> Query:
    """Let Python workers on this machine import the package from this folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = spark.sparkContext.environment
        known = [p for p in paths.get("PYTHONPATH", "").split(":") if p]
        here = str(Path(__file__).resolve().parent)
        paths["PYTHONPATH"] = ":".join(dict.fromkeys([here, *known]))
        return query(spark, sf_dir)

    return run


def _training_data_modules() -> list:
    """Modules with QUERIES and ORACLE_QUERIES of the separate training-data subpackage.

    Both may be absent; errors inside them are raised.
    """
    names = ("folioseek.llm", "corpus_pipeline")
    if not all(importlib.util.find_spec(name) for name in names):
        return []
    return [importlib.import_module("folioseek.llm.queries"), importlib.import_module(names[1])]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: fuzzy two-field search with filters, best ten with highlights."""
    index = saved_index(spark, "/root/testdata/sf0.001")
    return advanced_search(index, "the thereou quene", file_type="en", min_size=500)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the raw tables, written independently of the index."""
    found = oracle_queries()
    for module in _training_data_modules():
        found.update(module.ORACLE_QUERIES)
    return found
