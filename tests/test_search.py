"""Searches over tiny corpora worked out by hand."""

import math

import pytest

from folioseek import (
    DocumentIndex,
    advanced_search,
    bool_search,
    phrase_search,
    search_documents,
    search_many,
    summarize_hits,
)

ROWS = [
    ("/a/report.pdf", "pdf", "Cats chase mice. Dogs chase cats!\nNothing here."),
    ("/a/notes.csv", "csv", "the quick brown fox jumps over the lazy dog"),
    ("/b/cats.docx", "docx", "A story about birds"),
    ("/b/long.pdf", "pdf", "dog " * 300 + "cats"),
    ("/c/empty words.xlsx", "xlsx", "quick fox quick fox brown quick"),
]


@pytest.fixture(scope="module")
def index(make_index):
    return make_index(ROWS)


def paths(hits):
    return [row["file_path"] for row in hits.collect()]


def bm25(n, df, tf, dl, avgdl):
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    return 2.2 * idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))


def test_score_by_hand(index):
    hits = search_documents(index, "birds", fuzziness=0).collect()
    lengths = [8, 9, 4, 301, 6]
    assert [row["file_path"] for row in hits] == ["/b/cats.docx"]
    assert hits[0]["score"] == round(bm25(5, 1, 1, 4, sum(lengths) / 5), 6)


def test_repeated_word_counts_twice(index):
    once = search_documents(index, "birds", fuzziness=0).first()["score"]
    twice = search_documents(index, "birds Birds", fuzziness=0).first()["score"]
    assert twice == pytest.approx(2 * once, abs=2e-6)


def test_name_is_one_token_and_best_field_wins(index):
    assert paths(search_documents(index, "cats.docx", fuzziness=0)) == ["/b/cats.docx"]
    assert "/a/report.pdf" not in paths(search_documents(index, "report", fuzziness=0))
    by_name = search_documents(index, "cats.docx story", fuzziness=0).first()
    name = bm25(5, 1, 1, 1, 1.2)
    story = bm25(5, 1, 1, 4, sum([8, 9, 4, 301, 6]) / 5)
    assert by_name["score"] == round(max(name, story), 6)


def test_basic_hits_carry_highlights_or_an_empty_list(index):
    rows = {row["file_path"]: row for row in search_documents(index, "cats").collect()}
    assert rows["/a/report.pdf"]["highlights"] == [
        "<em>Cats</em> chase mice.",
        "Dogs chase <em>cats</em>!",
    ]
    only_name = search_documents(index, "cats.docx", fuzziness=0).first()
    assert only_name["highlights"] == []
    assert advanced_search(index, "cats.docx", fuzziness=0).first()["highlights"] is None


def test_fuzzy_expansions_are_highlighted_and_swaps_count_once(index):
    hit = search_documents(index, "bidrs").first()
    assert hit["file_path"] == "/b/cats.docx"
    assert hit["highlights"] == ["A story about <em>birds</em>"]
    assert paths(search_documents(index, "bidrs", fuzziness=0)) == []


def test_max_highlights(index):
    hit = search_documents(index, "cats", max_highlights=1).filter("file_type = 'pdf'")
    assert {len(row["highlights"]) for row in hit.collect()} == {1}


@pytest.mark.parametrize("text", ["", "...", "zzzzzzzz"])
def test_nothing_to_find(index, text):
    assert search_documents(index, text).collect() == []


def test_empty_text_is_no_text_in_advanced_search(index):
    assert len(paths(advanced_search(index, ""))) == 5


def test_missing_index_gives_no_rows(spark, tmp_path):
    absent = DocumentIndex(spark, str(tmp_path / "none"))
    assert not absent.exists
    assert search_documents(absent, "cats").collect() == []
    assert advanced_search(absent, file_type="pdf").collect() == []
    assert advanced_search(absent).columns == search_documents(absent, "x").columns


def test_filters_never_change_scores(index):
    free = {r["file_path"]: r["score"] for r in search_documents(index, "cats dog").collect()}
    kept = advanced_search(index, "cats dog", file_type="pdf", min_size=0).collect()
    assert kept and all(free[row["file_path"]] == row["score"] for row in kept)
    assert {row["file_type"] for row in kept} == {"pdf"}


def test_size_bounds_are_inclusive_and_zero_counts(index):
    size = len(ROWS[1][2])
    assert paths(advanced_search(index, min_size=size, max_size=size)) == ["/a/notes.csv"]
    assert paths(advanced_search(index, max_size=0)) == []
    assert paths(advanced_search(index, min_size=10, max_size=5)) == []


def test_type_is_case_sensitive_and_empty_is_unset(index):
    assert paths(advanced_search(index, file_type="PDF")) == []
    assert len(paths(advanced_search(index, file_type=""))) == 5


def test_constant_scores(index):
    assert {r["score"] for r in advanced_search(index).collect()} == {1.0}
    assert {r["score"] for r in advanced_search(index, file_type="pdf").collect()} == {0.0}


def test_sorts(index):
    by_name = paths(advanced_search(index, sort_by="file_name", sort_order="desc"))
    assert by_name[0] == "/a/report.pdf" and by_name[-1] == "/b/cats.docx"
    hits = advanced_search(index, "cats", sort_by="file_size", sort_order="asc").collect()
    sizes = [row["file_size"] for row in hits]
    assert sizes == sorted(sizes) and {row["score"] for row in hits} == {None}
    scores = [r["score"] for r in advanced_search(index, "cats dog", sort_order="asc").collect()]
    assert scores == sorted(scores)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_too_long_names_sort_last(make_index, order):
    index = make_index([("/x/" + "n" * 257, "csv", "words"), ("/x/a.csv", "csv", "words")])
    for text in (None, "words"):
        found = paths(advanced_search(index, text, sort_by="file_name", sort_order=order))
        assert found[0] == "/x/a.csv"


def test_unknown_sort_raises(index):
    with pytest.raises(ValueError):
        advanced_search(index, sort_by="colour")
    with pytest.raises(ValueError):
        advanced_search(index, sort_order="up")


def test_top_k_is_a_prefix_and_pages_tile(index):
    everything = paths(search_documents(index, "cats dog quick", None))
    assert len(everything) == 4
    for size in range(len(everything)):
        assert paths(search_documents(index, "cats dog quick", size)) == everything[:size]
    pages = [
        path
        for page in (1, 2, 3)
        for path in paths(search_documents(index, "cats dog quick", page=page, page_size=2))
    ]
    assert pages == everything


def test_no_near_term_is_left_out(make_index):
    """Three hundred terms within two edits of a word find three hundred documents."""
    letters = "abcdefghijklmnopqrst"
    words = [f"{a}lphabe{b}" for a in letters for b in letters][:300]
    index = make_index([(f"/n/{n}.csv", "csv", word) for n, word in enumerate(words)])
    assert search_documents(index, "zlphabez", None).count() == 300
    assert search_documents(index, "zlphabez", None, max_expansions=50).count() == 50


def test_all_highlights_on_request(make_index):
    index = make_index([("/h/a.csv", "csv", "cat one. " * 9)])
    few = search_documents(index, "cat").first()["highlights"]
    every = search_documents(index, "cat", max_highlights=None).first()["highlights"]
    assert (len(few), len(every)) == (5, 9)


def test_many_words_take_the_joined_route(index, monkeypatch):
    wanted = search_documents(index, "cats dog quick fox").collect()
    monkeypatch.setattr("folioseek.plans.search.LITERAL_WORDS", 1)
    found = search_documents(index, "cats dog quick fox").collect()
    assert found == wanted


def test_bool_search(index):
    assert paths(bool_search(index, must=["cats"], must_not=["dogs"])) == ["/b/long.pdf"]
    assert set(paths(bool_search(index, should=["birds", "lazy"]))) == {
        "/b/cats.docx",
        "/a/notes.csv",
    }
    assert paths(bool_search(index, must=["quick", "lazy"])) == ["/a/notes.csv"]
    assert paths(bool_search(index, must=["quick", "absent"])) == []
    assert paths(bool_search(index, must_not=["cats"])) == []
    lone = bool_search(index, must=["quick"]).collect()
    more = bool_search(index, must=["quick"], should=["lazy"]).collect()
    assert {r["file_path"] for r in lone} == {r["file_path"] for r in more}
    assert more[0]["score"] > lone[0]["score"]


def test_phrase_search(index):
    assert paths(phrase_search(index, "Quick brown fox")) == ["/a/notes.csv"]
    assert paths(phrase_search(index, "fox quick brown")) == []
    assert paths(phrase_search(index, "dog dog dog")) == ["/b/long.pdf"]
    assert paths(phrase_search(index, "quick fox")) == ["/c/empty words.xlsx"]
    assert paths(phrase_search(index, "absent fox")) == []
    assert paths(phrase_search(index, "")) == []


def test_search_many_equals_single_searches(spark, index):
    texts = {1: "cats dog", 2: "bidrs", 3: "quick fox quick", 4: "zzzzzz", 5: "cats.docx"}
    queries = spark.createDataFrame(list(texts.items()), "query_id int, query_text string")

    def found():
        rows = sorted(search_many(index, queries, 3).collect(), key=lambda r: (r[0], r[1]))
        return [(r["query_id"], r["file_path"], r["score"]) for r in rows]

    expected = [
        (n, row["file_path"], row["score"])
        for n, text in texts.items()
        for row in search_documents(index, text, 3).collect()
    ]
    assert found() == expected
    # Queries of the same words, in any order, have the same hits.
    twins = queries.unionByName(queries.selectExpr("query_id + 10 AS query_id", "reverse(split(query_text, ' ')) AS t")
        .selectExpr("query_id", "array_join(t, ' ') AS query_text"))
    both = search_many(index, twins, None).collect()
    ranked = {q: [(r["place"], r["file_path"], r["score"]) for r in both if r["query_id"] == q] for q in (1, 11)}
    assert sorted(ranked[1]) == sorted(ranked[11]) and len(ranked[1]) > 1
    marked = {(r["query_id"], r["file_path"]): r["highlights"] for r in search_many(index, queries).collect()}
    for n, text in texts.items():
        for row in search_documents(index, text).collect():
            assert marked[n, row["file_path"]] == row["highlights"]


def test_summary_lines(spark, index):
    hits = search_documents(index, "cats")
    lines = {r["file_path"]: r["summary"] for r in summarize_hits(hits).collect()}
    assert lines["/a/report.pdf"] == ["<em>Cats</em> chase mice.", "Dogs chase <em>cats</em>!"]
    assert lines["/b/long.pdf"][0].endswith("...") and len(lines["/b/long.pdf"][0]) == 103


def test_odd_paths_are_found(make_index):
    odd = ["/x/it's.csv", "/x/back\\slash.csv", "/x/p%20q é.csv", '/x/"quoted".csv']
    index = make_index([(path, "csv", f"alpha number{n}") for n, path in enumerate(odd)])
    assert sorted(paths(search_documents(index, "alpha"))) == sorted(odd)


def test_portuguese_index(make_index):
    index = make_index(
        [
            ("/p/a.pdf", "pdf", "As ações da Controladoria-Geral"),
            ("/p/b.pdf", "pdf", "Outro texto"),
        ],
        "pt",
    )
    hits = search_documents(index, "acao", fuzziness=0).collect()
    assert [row["file_path"] for row in hits] == ["/p/a.pdf"]
    assert hits[0]["highlights"] == ["As <em>ações</em> da Controladoria-Geral"]
    assert paths(phrase_search(index, "ações da controladoria")) == ["/p/a.pdf"]


def test_query_shapes_of_the_original_scripts(index):
    assert search_documents(index, "test", 10).columns
    assert set(paths(advanced_search(index, file_type="pdf"))) == {"/a/report.pdf", "/b/long.pdf"}
    advanced_search(index, "data", sort_by="file_size", sort_order="desc").collect()
    assert paths(
        advanced_search(index, min_size=1000, sort_by="file_size", sort_order="asc")
    ) == ["/b/long.pdf"]
    hits = advanced_search(
        index, "cats dogs", "pdf", 1000, sort_by="file_name", sort_order="desc"
    )
    assert paths(hits) == ["/b/long.pdf"]


def test_control_characters_stay_in_highlights(make_index):
    index = make_index([("/u/a.csv", "csv", "one\x01two word here. Next\x01 line\nword. ")])
    (hit,) = search_documents(index, "word", fuzziness=0).collect()
    assert hit["highlights"] == ["one\x01two <em>word</em> here.", "<em>word</em>."]
