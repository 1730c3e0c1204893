"""Text analysis."""

from folioseek.functions import listed

# A word is letters, marks, digits and underscores, joined inside
# by apostrophes or full stops. The possessive quantifiers match the same words
# and keep Java's matcher from recursing on long runs such as "a.a.a.a".
WORD_CHARS = r"\p{L}\p{M}\p{N}_"
TOKEN_PATTERN = rf"[{WORD_CHARS}]++(?:['’.][{WORD_CHARS}]++)*+"
PIECE_PATTERN = rf"{TOKEN_PATTERN}|[^{WORD_CHARS}]++"

# Letters folded before Portuguese analysis, one for one.
FOLD_FROM = "áàâãäéèêëíìîïóòôõöúùûüçñ"
FOLD_TO = "aaaaaeeeeiiiiooooouuuucn"

# Common Portuguese function words, accents folded.
STOP_WORDS_PT = (
    "a ao aos as ate com como da das de dele dela deles delas depois do dos e "
    "ela elas ele eles em entre era essa essas esse esses esta estas este estes "
    "eu foi foram ha isso isto ja lhe lhes mais mas me mesmo meu meus minha "
    "minhas muito na nao nas nem no nos nossa nosso num numa o os ou para pela "
    "pelas pelo pelos por qual quando que quem se sem ser seu seus so sua suas "
    "tambem te tem teu teus tua tuas um uma voce voces"
).split()

# Portuguese plural and adverb endings, first match wins. Each
# entry is (ending, replacement, letters that must stand before it).
SUFFIXES_PT = (
    ("amente", "o", 3),
    ("mente", "", 4),
    ("coes", "cao", 2),
    ("oes", "ao", 2),
    ("aes", "ao", 2),
    ("ais", "al", 2),
    ("eis", "el", 2),
    ("ois", "ol", 2),
    ("ns", "m", 2),
    ("res", "r", 3),
    ("s", "", 3),
)

ANALYZERS = ("standard", "pt")

# Steps of text normalisation, as (pattern, replacement).
NORMAL_STEPS = (
    (r"\r\n?", r"\n"),
    (r"[\x{200B}-\x{200D}\x{FEFF}]", ""),
    (r"[\t\p{Zs}]+", " "),
    (r"[\x00-\x09\x0B-\x1F\x7F]", ""),
    (r" ?\n ?", r"\n"),
    (r"\n{3,}", r"\n\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)


def check_analyzer(analyzer: str) -> None:
    if analyzer not in ANALYZERS:
        raise ValueError(f"unknown analyzer {analyzer!r}; known: {ANALYZERS}")


def words(x: str) -> str:
    """Lower-case words of a text, in order."""
    return f'regexp_extract_all(lower({x}), r"{TOKEN_PATTERN}", 0)'


def term_of(x: str, analyzer: str = "standard") -> str:
    """Index term of a lower-case word; null for a stop word."""
    if analyzer != "pt":
        return x
    folded = f"translate({x}, '{FOLD_FROM}', '{FOLD_TO}')"
    cases = " ".join(
        f"WHEN endswith(w, '{ending}') AND char_length(w) >= {before + len(ending)} "
        f"THEN concat(left(w, char_length(w) - {len(ending)}), '{replacement}')"
        for ending, replacement, before in SUFFIXES_PT
    )
    stem = f"CASE WHEN w IN ({listed(STOP_WORDS_PT)}) THEN NULL {cases} ELSE w END"
    return f"transform(array({folded}), w -> {stem})[0]"


def listed_terms(x: str, analyzer: str = "standard") -> str:
    """Index terms of a text as array<string>; null where a stop word was dropped."""
    check_analyzer(analyzer)
    if analyzer == "standard":
        return words(x)
    return f"transform({words(x)}, word -> {term_of('word', analyzer)})"


def placed_terms(x: str, analyzer: str = "standard") -> str:
    """Index terms of a text as array<struct<term, pos>>.

    A dropped stop word leaves a gap in the positions.
    """
    check_analyzer(analyzer)
    term = term_of("word", analyzer)
    placed = f"transform({words(x)}, (word, n) -> struct({term} AS term, n AS pos))"
    if analyzer == "pt":
        return f"filter({placed}, item -> item.term IS NOT NULL)"
    return placed


def normalize_text(x: str) -> str:
    """Tidy extracted text and keep its paragraphs.

    Line ends become newlines, control and zero-width characters go, runs of
    blanks become one space, and three or more newlines a paragraph gap.
    """
    for pattern, replacement in NORMAL_STEPS:
        x = f"regexp_replace({x}, r'{pattern}', '{replacement}')"
    return x
