"""Words, normalisation, Portuguese terms."""

import pytest
from pyspark.sql import functions as F

from folioseek.functions.text import normalize_text, placed_terms, words


def value(spark, text, expression):
    frame = spark.range(1).select(F.lit(text).alias("x"))
    return frame.select(F.expr(expression)).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The annual_report.pdf", ["the", "annual_report.pdf"]),
        ("don't stop. Now", ["don't", "stop", "now"]),
        ("Ação rápida, 1.000,50!", ["ação", "rápida", "1.000", "50"]),
        ("", []),
        ("... -- !!", []),
    ],
)
def test_words(spark, text, expected):
    assert value(spark, text, words("x")) == expected


def test_very_long_joined_word_does_not_overflow(spark):
    assert value(spark, "a." * 500_000 + "a", f"size({words('x')})") == 1


def test_portuguese_terms_fold_stem_and_leave_gaps(spark):
    placed = value(spark, "As ações do órgão, rapidamente", placed_terms("x", "pt"))
    assert [(item["term"], item["pos"]) for item in placed] == [
        ("acao", 1),
        ("orgao", 3),
        ("rapido", 4),
    ]


def test_unknown_analyzer():
    with pytest.raises(ValueError):
        placed_terms("x", "klingon")


def test_normalized_text_keeps_paragraphs(spark):
    text = " a \t b\r\n\r\n\r\n\r\nc​\x07d \n e\n"
    assert value(spark, text, normalize_text("x")) == "a b\n\ncd\ne"
