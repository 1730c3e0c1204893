"""Relevance arithmetic (BM25, Robertson and Zaragoza 2009)."""

from collections.abc import Mapping

from folioseek.schema import BM25_B, BM25_K1, SCORE_DIGITS


def real(value: float) -> str:
    return f"{value!r}D"


def by_field(values: Mapping[str, float], x: str = "field") -> str:
    """Constant per field."""
    pairs = ", ".join(f"'{name}', {real(value)}" for name, value in values.items())
    return f"map({pairs})[{x}]"


def rarity(docs: str, df: str) -> str:
    """Inverse document frequency; never negative."""
    return f"ln(1 + ({docs} - {df} + 0.5D) / ({df} + 0.5D))"


def share_of_length(dl: str, average: str | float) -> str:
    """How a document's length counts against its occurrences."""
    mean = real(average) if isinstance(average, float) else average
    return f"{real(1 - BM25_B)} + {real(BM25_B)} * {dl} / {mean}"


def saturation(tf: str, dl: str, average: str) -> str:
    """Share of a term's weight that a document earns."""
    share = share_of_length(dl, average)
    return f"{real(BM25_K1 + 1)} * {tf} / ({tf} + {real(BM25_K1)} * ({share}))"


def most_saturation(most_tf: int, least_ratio: float, average: float) -> float:
    """No less than `saturation` of postings with at most this tf and at least this dl / tf."""
    share = (1 - BM25_B) / most_tf + BM25_B * least_ratio / average
    return (BM25_K1 + 1) / (1 + BM25_K1 * share)


def rounded(score: str) -> str:
    """Scores are rounded before ordering, so that sums compare alike."""
    return f"round({score}, {SCORE_DIGITS})"
