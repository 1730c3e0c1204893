"""Edit distances and the keys that make near words meet in an equi-join.

A swap of two neighbouring letters counts as one edit. Lengths are in
characters.
"""

from folioseek.functions import quoted, strings

# Letters at the start of a word that deletion keys are made from, and those at the
# end of terms of LONG_TERM letters and more, between which two letters lie at least:
# no edit counts for both.
KEY_PREFIX, KEY_SUFFIX, LONG_TERM = 12, 6, 20
# Stands between them; no word holds it.
_GAP = " "

# Words shorter than the first bound take no edit under "AUTO",
# those shorter than the second take one, all others two.
AUTO_ONE_EDIT = 3
AUTO_TWO_EDITS = 6


def check_fuzziness(fuzziness: str | int) -> None:
    if fuzziness not in ("AUTO", 0, 1, 2):
        raise ValueError("fuzziness must be 'AUTO', 0, 1 or 2")


def allowed_edits(x: str, fuzziness: str | int = "AUTO") -> str:
    check_fuzziness(fuzziness)
    if fuzziness != "AUTO":
        return str(int(fuzziness))
    return (
        f"CASE WHEN char_length({x}) < {AUTO_ONE_EDIT} THEN 0 "
        f"WHEN char_length({x}) < {AUTO_TWO_EDITS} THEN 1 ELSE 2 END"
    )


def allowed_edits_of(word: str, fuzziness: str | int = "AUTO") -> int:
    """`allowed_edits` for a word the driver holds."""
    check_fuzziness(fuzziness)
    if fuzziness != "AUTO":
        return int(fuzziness)
    return (len(word) >= AUTO_ONE_EDIT) + (len(word) >= AUTO_TWO_EDITS)


def swaps(x: str) -> str:
    """Every word made by swapping two neighbouring letters."""
    places = f"if(char_length({x}) > 1, sequence(1, char_length({x}) - 1), array())"
    return (
        f"transform({places}, i -> concat(substring({x}, 1, i - 1), "
        f"substring({x}, i + 1, 1), substring({x}, i, 1), substring({x}, i + 2)))"
    )


def swaps_of(word: str) -> str:
    """`swaps` of a word the driver holds, as literals."""
    return strings(
        [
            word[:at] + word[at + 1] + word[at] + word[at + 2 :]
            for at in range(len(word) - 1)
        ]
    )


def edits_between(left: str, right: str, most: str, left_swaps: str | None = None) -> str:
    """Edits from one word to the other if at most `most` (0-2), else null.

    One swap changes plain Levenshtein by two, so the swap tests run only for
    words whose plain distance is in reach of them.
    """
    ours, theirs = left_swaps or swaps(left), swaps(right)
    one = f"plain = 1 OR (plain = 2 AND array_contains({ours}, {right}))"
    two = (
        f"plain = 2 OR (plain IN (3, 4) AND ("
        f"exists({ours}, word -> levenshtein(word, {right}, 1) >= 0) OR "
        f"exists({theirs}, word -> levenshtein(word, {left}, 1) >= 0) OR "
        f"arrays_overlap({ours}, {theirs})))"
    )
    return (
        f"transform(array(levenshtein({left}, {right}, 4)), plain -> CASE "
        f"WHEN plain = 0 THEN 0 WHEN {most} >= 1 AND ({one}) THEN 1 "
        f"WHEN {most} >= 2 AND ({two}) THEN 2 END)[0]"
    )


def near_literal(word: str, x: str, length: str, most: int) -> str:
    """Struct (token, edits) if a term may be near a known word, else null."""
    token = quoted(word)
    test = f"{length} BETWEEN {len(word) - most} AND {len(word) + most}"
    if most == 0:
        test, edits = f"{x} = {token}", "0"
    else:
        test += f" AND levenshtein({token}, {x}, {2 * most}) >= 0"
        edits = edits_between(token, x, str(most), swaps_of(word))
    return f"if({test}, struct({token} AS token, {edits} AS edits), NULL)"


def _deletions(s: str) -> tuple[str, str, str]:
    """Words left after deleting none, one or two letters of a short word."""
    last = f"char_length({s})"
    one = (
        f"if({last} > 0, transform(sequence(1, {last}), "
        f"i -> concat(left({s}, i - 1), substring({s}, i + 1))), {_NONE})"
    )
    two = (
        f"if({last} > 1, flatten(transform(sequence(1, {last} - 1), "
        f"i -> transform(sequence(i + 1, {last}), j -> concat("
        f"left({s}, i - 1), substring({s}, i + 1, j - i - 1), substring({s}, j + 1))))), {_NONE})"
    )
    return f"array({s})", one, two


_NONE = "cast(array() AS array<string>)"


def deletion_keys(x: str, most: str) -> str:
    """Words left after deleting up to `most` (0-2) letters near the start.

    Two words within `most` edits always share a key: the letters both keep
    form a common word that each reaches by at most `most` deletions, and
    cutting both to a prefix only shortens that word. At most 79 keys a word;
    a word with repeated letters may give a key more than once.
    """
    none, one, two = _deletions("s")
    return (
        f"transform(array(left({x}, {KEY_PREFIX})), s -> concat({none}, "
        f"if({most} >= 1, {one}, {_NONE}), if({most} >= 2, {two}, {_NONE})))[0]"
    )


def _long_keys(x: str, most: str) -> str:
    """Keys of a long word: its beginning and its end, after up to `most` deletions in both.

    An edit falls into the beginning, the end or between them, so that the
    deletions of two near words share a key that says something of both.
    """
    heads, tails = _deletions("p"), _deletions("q")

    def pairs(head: int, tail: int) -> str:
        return f"flatten(transform({heads[head]}, a -> transform({tails[tail]}, b -> concat(a, '{_GAP}', b))))"

    keys = (
        f"concat({pairs(0, 0)}, if({most} >= 1, concat({pairs(1, 0)}, {pairs(0, 1)}), {_NONE}), "
        f"if({most} >= 2, concat({pairs(2, 0)}, {pairs(1, 1)}, {pairs(0, 2)}), {_NONE}))"
    )
    tail = f"transform(array(right({x}, {KEY_SUFFIX})), q -> {keys})[0]"
    return f"transform(array(left({x}, {KEY_PREFIX})), p -> {tail})[0]"


def saved_keys(x: str) -> str:
    """Keys of an index term, for any fuzziness; each once, and at most 172."""
    return f"array_distinct(if(char_length({x}) >= {LONG_TERM}, {_long_keys(x, '2')}, {deletion_keys(x, '2')}))"


def sought_keys(x: str, most: str) -> str:
    """Keys under which the terms within `most` edits of a word are saved; each once.

    A word whose length is near that of long terms looks under both kinds.
    """
    return (
        f"array_distinct(concat("
        f"if(char_length({x}) - {most} < {LONG_TERM}, {deletion_keys(x, most)}, {_NONE}), "
        f"if(char_length({x}) + {most} >= {LONG_TERM}, {_long_keys(x, most)}, {_NONE})))"
    )
