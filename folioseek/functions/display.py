"""Highlights and result summaries."""

from collections.abc import Callable

from folioseek.functions.text import PIECE_PATTERN, term_of

# Fixed values of highlighting and of the summary shown for a hit.
MARK_OPEN, MARK_CLOSE = "<em>", "</em>"
MAX_HIGHLIGHTS = 5
SUMMARY_HIGHLIGHTS = 2
SUMMARY_LENGTH = 100

# What stands between sentences, and what counts as white space at the
# ends of a summary line.
SENTENCE_GAP = r"(?<=[.!?])\s+|[\r\n]+"
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def sentences(x: str) -> str:
    """Split after . ! ? followed by white space, and at line ends."""
    return f"filter(split({x}, r'{SENTENCE_GAP}'), part -> length(part) > 0)"


def highlights(
    x: str,
    known: Callable[[str], str],
    most: int | None = MAX_HIGHLIGHTS,
    analyzer: str = "standard",
) -> str:
    """First `most` sentences holding a term that is `known` (all if None), those words marked.

    A sentence is cut into words and what stands between them, so marking and
    joining the pieces gives the sentence back.
    """
    pieces = f'transform({sentences(x)}, s -> regexp_extract_all(s, r"{PIECE_PATTERN}", 0))'
    found = f"coalesce({known(term_of('lower(piece)', analyzer))}, false)"
    marked = f"if({found}, concat('{MARK_OPEN}', piece, '{MARK_CLOSE}'), piece)"
    holding = f"filter({pieces}, part -> exists(part, piece -> {found}))"
    shown = holding if most is None else f"slice({holding}, 1, {most})"
    return f"transform({shown}, part -> array_join(transform(part, piece -> {marked}), ''))"


def summary_lines(x: str) -> str:
    """First two highlights on one line each, cut to 100 characters."""
    flat = (
        f"regexp_replace(replace(item, '\\n', ' '), r'^{SPACE}+|{SPACE}+$', '')"
    )
    short = (
        f"if(char_length(t) > {SUMMARY_LENGTH}, "
        f"concat(left(t, {SUMMARY_LENGTH}), '...'), t)"
    )
    return (
        f"transform(transform(slice({x}, 1, {SUMMARY_HIGHLIGHTS}), item -> {flat}), "
        f"t -> {short})"
    )
