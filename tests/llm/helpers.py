"""Small tables for the operators' tests."""

import random

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, fp long, n int, words string, block int, cell string, row long, key string, findings string"
)
# Extra columns whose names the operators use inside.
EXTRA = (7, 7, 7, "w", 7, "c", 7, "k", "f")

LONG = "lorem ipsum dolor sit amet " * 3000


def documents(spark, rows):
    """Rows of (doc_id, text[, lang, source]) as a documents table with clashing extras."""
    full = []
    for row in rows:
        i, text, lang, source = (*row, "en", "web")[:4] if len(row) == 2 else row
        full.append((i, text, lang, source, None if text is None else len(text), *EXTRA))
    return spark.createDataFrame(full, DOCS)


# Nulls in every column, empty, blank and very long texts, a repeated row and a repeated id.
ODD_ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\f\r "),
    (4, LONG),
    (5, LONG),
    (6, "single"),
    (7, "two words", None, None),
    (8, "two words", None, "web"),
    (9, "same row"),
    (9, "same row"),
    (10, "one text of ten"),
    (10, "other text of ten"),
    (None, "no id here"),
    (None, None, None, None),
    (11, "Ünïcödé  text with spaces 漢字 \U0001f600 end"),
    (12, "a a a a a a a a a a\na a a\na a a"),
]


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or [f"{a}{b}" for a in "bcdfghklmn" for b in ("a", "en", "ir", "out")]
    return " ".join(rng.choice(words) for _ in range(n))
