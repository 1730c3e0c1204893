"""Fuzzy matching against brute force."""

import random

import pytest

from conftest import as_documents
from folioseek import DocumentIndex, index_documents, search_many
from folioseek.functions.edits import allowed_edits_of
from folioseek.operators.matching import (
    best_expansions,
    near_literals,
    near_words,
    term_keys,
)
from folioseek.plans import search

NEAR = "field string, term string, token string, edits int, df long"


def edits(left, right):
    """Unrestricted Damerau-Levenshtein distance, textbook form."""
    last, far = {}, len(left) + len(right)
    table = {(-1, -1): far}
    for i in range(len(left) + 1):
        table[i, -1], table[i, 0] = far, i
    for j in range(len(right) + 1):
        table[-1, j], table[0, j] = far, j
    for i in range(1, len(left) + 1):
        match = 0
        for j in range(1, len(right) + 1):
            at = last.get(right[j - 1], 0), match
            same = left[i - 1] == right[j - 1]
            if same:
                match = j
            table[i, j] = min(
                table[i - 1, j - 1] + (not same),
                table[i, j - 1] + 1,
                table[i - 1, j] + 1,
                table[at[0] - 1, at[1] - 1] + (i - at[0] - 1) + 1 + (j - at[1] - 1),
            )
        last[left[i - 1]] = i
    return table[len(left), len(right)]


@pytest.fixture(scope="module")
def terms():
    chance = random.Random(7)
    made = {
        "".join(chance.choice("abcé") for _ in range(chance.randint(1, 8))) for _ in range(1500)
    }
    long = "".join(chance.choice("abcdef") for _ in range(30))
    near_long = {long[:at] + x + long[at + 1 :] for at in (0, 9, 20, 29) for x in ("", "z", "zz")}
    return sorted(made | near_long | {long, "ca", "abc", "it's"})


@pytest.fixture(scope="module")
def vocabulary(spark, terms):
    rows = [("content", term, len(term), 1) for term in terms]
    return spark.createDataFrame(rows, "field string, term string, term_len int, df long")


@pytest.mark.parametrize("fuzziness", ["AUTO", 0, 1, 2])
def test_both_ways_find_what_brute_force_finds(spark, terms, vocabulary, fuzziness):
    chance = random.Random(11)
    words = sorted(set(chance.sample(terms, 12)) | {"a", "ab", "abc", "it's", max(terms, key=len)})
    expected = set()
    for word in words:
        most = allowed_edits_of(word, fuzziness)
        for term in terms:
            if abs(len(word) - len(term)) <= most and (d := edits(word, term)) <= most:
                expected.add((word, term, d))

    def found(near):
        rows = [(row["token"], row["term"], row["edits"]) for row in near.collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    tokens = spark.createDataFrame([(word,) for word in words], "token string")
    assert found(near_literals(vocabulary, words, fuzziness)) == expected
    assert found(near_words(vocabulary, tokens, fuzziness)) == expected


@pytest.mark.parametrize("fuzziness", ["AUTO", 1, 2])
def test_saved_keys_of_long_terms(spark, fuzziness):
    """Words around the length from which terms are saved by both ends, two edits anywhere."""
    chance = random.Random(3)
    terms = {"".join(chance.choice("ab") for _ in range(n)) for n in range(15, 27) for _ in range(4)}

    def changed(word):
        at, kind = chance.randrange(len(word)), chance.randrange(4)
        swapped = word[:at] + word[at + 1 : at + 2] + word[at] + word[at + 2 :]
        return (word[:at] + "c" + word[at:], word[:at] + word[at + 1 :], word[:at] + "c" + word[at + 1 :], swapped)[kind]

    near = {changed(changed(word)) for word in terms for _ in range(6)}
    terms, words = sorted(terms | near), chance.sample(sorted(near), 60)
    expected = {
        (word, term, d)
        for word in words
        for term in terms
        if abs(len(word) - len(term)) <= 2
        and (d := edits(word, term)) <= (2 if fuzziness == "AUTO" else fuzziness)
    }
    vocabulary = spark.createDataFrame(
        [("content", term, len(term), 1) for term in terms], "field string, term string, term_len int, df long"
    )
    tokens = spark.createDataFrame([(word,) for word in words], "token string")
    keys = term_keys(vocabulary.select("term"))
    assert keys.groupBy("term").count().agg({"count": "max"}).first()[0] <= 172
    found = near_words(vocabulary, tokens, fuzziness, keys).collect()
    assert {(r["token"], r["term"], r["edits"]) for r in found} == expected and len(found) == len(expected)
    assert len(expected) > 60


def test_saved_keys_spare_the_vocabulary(spark, tmp_path):
    """Nothing is made from the vocabulary when words are sought, and hits are the same."""
    rows = [(f"/k/{n}.csv", "csv", f"common word{n} abcdefghijklmnopqrst{n}") for n in range(60)]
    hits = {}
    queries = spark.createDataFrame(
        [(n, f"wrod{n} abcdefghijklmnopqrts{n}") for n in range(40)], "query_id int, query_text string"
    )
    for saved in (False, True):
        folder = str(tmp_path / str(saved))
        DocumentIndex.create(spark, folder, near_keys=saved)
        for part in (rows[:40], rows[40:]):
            index_documents(DocumentIndex(spark, folder), as_documents(spark, part))
        index = DocumentIndex(spark, folder)
        keys = index.saved_term_keys()
        assert (keys is not None) == saved
        found = search_many(index, queries, 5).select("query_id", "place", "file_path", "score")
        hits[saved] = sorted(map(tuple, found.collect()))
    assert hits[True] == hits[False] and len(hits[True]) > 60
    tokens = spark.createDataFrame([("wrod7",)], "token string")
    near = near_words(search._vocabulary(index), tokens, "AUTO", keys)
    text = near._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate explode") == 1 and "key_bucket" in text


@pytest.mark.parametrize("word, most", [("ab", 0), ("abc", 1), ("abcde", 1), ("abcdef", 2)])
def test_allowed_edits_at_the_bounds(word, most):
    assert allowed_edits_of(word) == most


def test_best_expansions_cap_and_share_df(spark):
    rows = [("content", f"t{n:03}", "t000x", 1 + (n > 0), n + 1) for n in range(80)]
    near = spark.createDataFrame(rows, NEAR)
    kept = best_expansions(near, {"content": 1000.0}, most=50).collect()
    assert len(kept) == 50
    assert {row["term"] for row in kept} == {f"t{n:03}" for n in range(50)}
    assert len({row["idf"] for row in kept}) == 1


def test_counts_of_batches_add_up(spark):
    rows = [("content", "abc", "abc", 0, 2), ("content", "abc", "abc", 0, -2)]
    near = spark.createDataFrame(rows, NEAR)
    assert best_expansions(near, {"content": 10.0}).collect() == []
