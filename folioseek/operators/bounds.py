"""Which postings files can hold one of the best documents.

A file's largest term frequency and its least length for each occurrence bound
the weight of all its postings from above. A document whose posting of a term lies in a file
earns at most that bound and, from the query's other terms of the field, their
own largest bounds. If that is less than a score that enough documents are known
to reach, none of the file's postings can change the best.
"""

from collections.abc import Iterator, Mapping

from pyspark.sql import Row

from folioseek.functions.ranking import most_saturation

# Scores are rounded to six places, sums in floating point differ by less.
SLACK = 1e-5


def _holds(place: Row, term: Row) -> bool:
    if place["field"] != term["field"]:
        return False
    wanted = term["term"].encode()
    return place["first_term"].encode() <= wanted <= place["last_term"].encode()


def _bounds(
    places: list[Row], terms: list[Row], averages: Mapping[str, float]
) -> Iterator[tuple[Row, int, float]]:
    """File, number of a term it may hold, and the most that a posting of it earns."""
    for place in places:
        most = most_saturation(place["most_tf"], place["least_ratio"], averages[place["field"]])
        for number, term in enumerate(terms):
            if _holds(place, term):
                yield place, number, term["boost"] * most


def heaviest_files(
    places: list[Row], terms: list[Row], averages: Mapping[str, float], count: int
) -> list[Row]:
    """For each term the files with the largest bounds, of `count` rows at least."""
    of_term: dict[int, list] = {}
    for place, number, bound in _bounds(places, terms, averages):
        of_term.setdefault(number, []).append((-bound, place["file"], place))
    chosen = []
    for found in of_term.values():
        rows = 0
        for _, _, place in sorted(found, key=lambda x: x[:2]):
            chosen.append(place)
            rows += place["rows"]
            if rows >= count:
                break
    return chosen


def reaching_files(
    places: list[Row], terms: list[Row], averages: Mapping[str, float], score: float
) -> list[Row]:
    """Files in which a posting can belong to a document of at least this score."""
    bounds = list(_bounds(places, terms, averages))
    largest = [0.0] * len(terms)
    for _, number, bound in bounds:
        largest[number] = max(largest[number], bound)
    total: dict[str, float] = {}
    for term, most in zip(terms, largest):
        total[term["field"]] = total.get(term["field"], 0.0) + most
    return [
        place
        for place, number, bound in bounds
        if total[place["field"]] - largest[number] + bound + SLACK >= score
    ]
