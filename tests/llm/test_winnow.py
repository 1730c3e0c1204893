"""Every window that documents and items share, against plain Python."""

import random
import re

import pytest
from helpers import ODD_ROWS, documents, prose

from folioseek.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        n = min(13, len(own))
        if n:
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    n = len(words)
    return n, len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= n


def items_table(spark, items):
    return spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    few = ["ba", "be", "bi", "bo"]
    items = [(i, prose(i, 5 + 4 * i)) for i in range(12)]
    items += [(50, "Ba be, ba BE bo"), (51, ""), (52, None), (53, "..."), (54, "lone"), (3, prose(3, 17))]
    items += [(60, prose(60, 40, few)), (61, prose(61, 9, few)), (62, "x " * 30)]
    docs = list(ODD_ROWS)
    for i in range(60):
        parts = [prose(900 + i, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            words = words_of(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(words) - 13))
            parts += [" ".join(words[a : a + rng.choice([12, 13, 14, 20])]).upper(), prose(rng.random(), 7)]
        docs.append((100 + i, "; ".join(parts)))
    docs += [(200, prose(7, 300, few)), (201, "x " * 50 + "lone"), (202, prose(60, 40, few))]
    return docs, items


def test_against_brute_force(spark, case):
    docs, items = case
    found = winnow.contamination(documents(spark, docs), items_table(spark, items)).collect()
    got = sorted(
        (str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found
    )
    assert all(r.n_items == len(r["items"]) for r in found)
    assert got == sorted((str(d[0]), *expected(d[1], items)) for d in docs)
    assert sum(r.contaminated for r in found) > 5


def test_chunks_do_not_matter(spark, case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(winnow, "CHUNK", 50)
    texts = [(d[1] or "").encode() for d in docs]
    whole = winnow._marks(texts, [5, 9], None, False)
    parts = [winnow._marks(texts[a:b], [5, 9], None, False) for a, b in winnow._chunks(texts)]
    assert len(parts) > 10
    assert whole == ([n for p in parts for n in p[0]], [m for p in parts for m in p[1]])


def test_empty_tables(spark, case):
    docs, items = case
    none = winnow.contamination(documents(spark, docs), items_table(spark, [])).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.contaminated for r in none)
    assert winnow.contamination(documents(spark, []), items_table(spark, items)).collect() == []


def test_drop_contaminated(spark, case):
    docs, items = case
    table = documents(spark, docs)
    kept = winnow.drop_contaminated(table, items_table(spark, items))
    bad = {d[0] for d in docs if expected(d[1], items)[3]}
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in bad)


def test_rows_without_id_and_ids_that_repeat(spark):
    items = [(0, prose("item", 30))]
    docs = [(None, prose("item", 30)), (None, prose("clean", 40)), (None, None), (1, "kept row")]
    docs += [(1, f"{prose('item', 30)} more"), (2, prose("item", 30)), (2, prose("item", 30))]
    table, bench = documents(spark, docs), items_table(spark, items)
    found = winnow.contamination(table, bench).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found)
    assert got == sorted((str(d[0]), *expected(d[1], items)) for d in docs)
    kept = winnow.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, docs[1:4]))
