"""Base counts against plain Python; outliers; odd rows."""

import re

import numpy as np
from helpers import ODD_ROWS, documents, prose

from folioseek.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dups, len(covered)


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_counts_and_odd_rows(spark):
    rows = [*ODD_ROWS, (20, "x y z\nx y z\n\n \nx y z q x y"), (21, "##a $b | c <d>\n" * 4)]
    found = quality.quality_verdicts(documents(spark, rows)).collect()
    assert sorted(map(str, map(counts, found))) == sorted(str(expected(r[1])) for r in rows)
    for row in found:
        n, _, _, _, repeated = counts(row)
        assert row.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (row.base_failed and row.kept)


def test_junk_is_rejected_and_prose_kept(spark):
    good = [(i, prose(i, 80 + 3 * i), "en", "web") for i in range(150)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in prose(i, 120).split()), "en", "web") for i in range(12)]
    found = quality.quality_verdicts(documents(spark, good + bad)).collect()
    kept = {r.doc_id for r in found if r.kept}
    assert kept == {r.doc_id for r in found if not r.base_failed and r.doc_id < 1000}
    assert len(kept) > 120


def test_estimate_ignores_a_third_of_outliers(spark):
    """The robust mean stays with the majority, unlike the plain one."""
    rng = np.random.default_rng(1)
    near = rng.normal(5000, 300, (200, quality.P)).round().astype(int)
    far = rng.normal(9000, 100, (90, quality.P)).round().astype(int)
    points = spark.createDataFrame(
        [("c", *map(int, r)) for r in np.vstack([near, far])],
        "cell string, " + ", ".join(f"x{i} long" for i in range(quality.P)),
    )
    row = quality.robust_estimates(points, 60, 6).first()
    assert all(abs(row[f"m{i}"] - near[:, i].mean()) < 120 for i in range(quality.P))


def test_few_rows_and_none(spark):
    found = quality.quality_verdicts(documents(spark, [(1, prose(1, 60)), (2, "# " * 90)])).collect()
    assert {r.doc_id: r.kept for r in found} == {1: True, 2: False}
    assert quality.quality_verdicts(documents(spark, [])).collect() == []


def test_keep_good_returns_whole_rows(spark):
    docs = documents(spark, [(1, prose(1, 60)), (2, "short"), (3, None), (4, prose(2, 70))])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_keep_good_judges_rows_with_one_id_or_none_alone(spark):
    rows = [(5, prose(1, 60)), (5, "short"), (None, prose(2, 60)), (None, prose(3, 60)), (None, "x")]
    kept = quality.keep_good(documents(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted(prose(seed, 60) for seed in (1, 2, 3))
