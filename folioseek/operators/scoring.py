"""From matched postings to scored documents."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from folioseek.functions.ranking import by_field, rounded, saturation
from folioseek.schema import TEXT_FIELDS

VERSION = ("file_path", "batch_id")

# A version and the number of the documents file of its batch that holds it.
PLACED = (*VERSION, "file_part")


def score_documents(
    matched: DataFrame,
    averages: Mapping[str, float],
    keys: tuple[str, ...] = (),
    fields: tuple[str, ...] = TEXT_FIELDS,
) -> DataFrame:
    """Best field's BM25 score of every matched document.

    `matched` holds postings with the query's `boost`; `averages` gives the mean
    length per field. One grouping: each field is summed on its own and the
    largest sum is the score.
    """
    earned = f"boost * {saturation('tf', 'dl', by_field(averages))}"
    sums = [
        F.expr(f"sum({earned}) FILTER (WHERE field = '{name}')").alias(f"_{name}")
        for name in fields
    ]
    best = rounded(f"greatest({', '.join(f'_{name}' for name in fields)}, 0D)")
    grouped = matched.groupBy(*keys, *PLACED).agg(*sums)
    return grouped.selectExpr(*keys, *PLACED, f"{best} AS score")


def score_postings(matched: DataFrame, averages: Mapping[str, float]) -> DataFrame:
    """`score_documents` for a single index term: one posting a document.

    Nothing has to be grouped, so the search runs without a shuffle.
    """
    earned = f"boost * {saturation('tf', 'dl', by_field(averages))}"
    return matched.selectExpr(*PLACED, f"{rounded(earned)} AS score")


def matched_documents(matched: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Matched documents without a score, each once."""
    return matched.select(*PLACED, *carry).distinct()


def without_superseded(rows: DataFrame, superseded: DataFrame | None) -> DataFrame:
    """Drop document versions that a later batch replaced."""
    if superseded is None:
        return rows
    replaced = superseded.select("file_path", F.col("old_batch_id").alias("batch_id"))
    return rows.join(replaced, list(VERSION), "left_anti")
