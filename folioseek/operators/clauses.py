"""Boolean clauses and exact phrases over postings."""

from pyspark.sql import DataFrame, functions as F

from folioseek.functions.ranking import real, rounded, saturation
from folioseek.operators.scoring import PLACED


def match_clauses(
    matched: DataFrame,
    must: list[str],
    should: list[str],
    must_not: list[str],
    average: float,
) -> DataFrame:
    """Documents with every `must`, no `must_not` and, without `must`, a `should`.

    `matched` holds the postings of all clause terms in one field, with `boost`.
    One grouping decides everything: a term has one posting per document, so
    counting `must` postings counts the terms present.
    """
    term = F.col("term")
    earned = F.expr(f"boost * {saturation('tf', 'dl', real(average))}")
    grouped = matched.groupBy(*PLACED).agg(
        F.count_if(term.isin(must)).alias("_must"),
        F.count_if(term.isin(should)).alias("_should"),
        F.count_if(term.isin(must_not)).alias("_not"),
        F.sum(F.when(term.isin(must + should), earned)).alias("_sum"),
    )
    wanted = F.col("_must") == len(set(must)) if must else F.col("_should") > 0
    return grouped.filter(wanted & (F.col("_not") == 0)).select(
        *PLACED, F.expr(rounded("_sum")).alias("score")
    )


def match_phrase(
    matched: DataFrame, terms: list[str], offsets: list[int], boost: float, average: float
) -> DataFrame:
    """Documents where the terms stand at the given offsets from one another.

    Each term has one posting per document, so a grouping lines the position
    lists up in columns; shifting and intersecting them happens in the row.
    """
    slots = sorted(set(terms))
    grouped = matched.groupBy(*PLACED).agg(
        *[
            F.any_value(
                F.when(F.col("term") == term, F.col("positions")), ignoreNulls=True
            ).alias(f"_at{n}")
            for n, term in enumerate(slots)
        ],
        F.max("dl").alias("dl"),
    )
    starts = None
    for term, offset in zip(terms, offsets):
        shifted = F.expr(f"transform(_at{slots.index(term)}, at -> at - {offset})")
        starts = shifted if starts is None else F.array_intersect(starts, shifted)
    earned = f"{real(boost)} * {saturation('tf', 'dl', real(average))}"
    return (
        grouped.withColumn("tf", F.size(starts))
        .filter(F.col("tf") > 0)
        .select(*PLACED, F.expr(rounded(earned)).alias("score"))
    )
