"""Counts and base scores against plain Python; exchange raises the likelihood."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD_ROWS, documents

from folioseek.llm import classlm

SMALL = {"n_classes": 6, "n_words": 20, "n_endings": 8, "n_known": 30, "passes": 3}


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def known_words(counts, n_known):
    """Whole bins of frequency, the highest first, while they fit."""
    bins = {}
    for w, n in counts.items():
        bins.setdefault(math.floor(16 * math.log2(n)), []).append((-n, w))
    found = []
    for b in sorted(bins, reverse=True):
        if len(found) + len(bins[b]) > n_known:
            break
        found += bins[b]
    return [w for _, w in sorted(found)]


def training(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 != 0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    texts = []
    for _ in range(160):
        line = [x for _ in range(rng.randint(3, 12)) for x in ("The", rng.choice(nouns), rng.choice(verbs))]
        texts.append(" ".join(line))
    return [*ODD_ROWS, *((100 + i, t) for i, t in enumerate(texts))]


def test_base_scores(spark, rows):
    found = classlm.class_model_scores(documents(spark, rows), **SMALL).collect()
    counts = Counter(t for i, text, *_ in rows if training(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for i, text, *_ in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        wanted.append((str(i), not training(i), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    ]
    assert sorted(got) == sorted(wanted)
    held = [r for r in found if r.held_out and r.doc_id >= 100]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_scores(spark, rows):
    """The score is the sum of the transitions and emissions of the classes that were found."""
    frame = documents(spark, rows)
    kept = {}
    original = classlm._tables
    try:
        classlm._tables = lambda *a: kept.setdefault("t", original(*a))
        found = classlm.class_model_scores(frame, **SMALL).collect()
    finally:
        classlm._tables = original
    table, items = kept["t"], classlm.Items(SMALL["n_words"], SMALL["n_endings"])
    counts = Counter(t for i, text, *_ in rows if training(i) for t in classlm.tokens_of(text))
    top = known_words(counts, SMALL["n_known"])
    assert 3 < len(top) < len(counts)
    number = dict(zip(top, items.of_rank(top).tolist(), strict=True))
    assert np.allclose((10**table.transitions).sum(axis=1), 1)
    wanted = []
    for i, text, *_ in rows:
        before, value = table.classes[0], 0.0
        for w in classlm.tokens_of(text):
            c = table.classes[number.get(w, items.of_ending(w))]
            value += table.transitions[before, c] + math.log10(counts[w] + 0.1) - table.room[c]
            before = c
        wanted.append((str(i), round(value, 6)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in found) == sorted(wanted)


def test_exchange_is_exact_for_one_move():
    """A single move changes the likelihood as counting all over says."""
    rng = np.random.default_rng(0)
    n, k = 30, 5
    pairs = rng.integers(0, 6, (n, n))
    classes = np.r_[0, rng.integers(1, k, n - 1)]

    def contexts(of):
        onehot = np.eye(k, dtype=int)[of]
        return pairs @ onehot, pairs.T @ onehot

    def value(of):
        return classlm.likelihood(classlm.class_bigrams(contexts(of)[0], of, k))

    for item in range(1, n):
        follows, precedes = contexts(classes)
        # Both directions are kept, so rows and columns must have equal sums as in a text.
        moved = classlm.exchange(classes, follows, precedes, np.diagonal(pairs), np.array([item]), k)
        if (pairs.sum(axis=1) == pairs.sum(axis=0)).all():
            options = [value(np.where(np.arange(n) == item, c, classes)) for c in range(1, k)]
            assert value(moved) >= max(options) - 1e-6


def test_clusters_follow_contexts(spark, rows):
    frame = documents(spark, rows[len(ODD_ROWS) :])
    kept = {}
    original = classlm._tables
    try:
        classlm._tables = lambda *a: kept.setdefault("t", original(*a))
        classlm.class_model_scores(frame, n_classes=5, n_words=90, n_endings=4, n_known=90, passes=4).count()
    finally:
        classlm._tables = original
    counts = Counter(t for i, text, *_ in rows[len(ODD_ROWS) :] if training(i) for t in classlm.tokens_of(text))
    top = known_words(counts, 90)
    of = dict(zip(top, kept["t"].classes[classlm.Items(90, 4).of_rank(top)].tolist(), strict=True))
    nouns, verbs = (Counter(of[w] for w in of if w[:1] == s) for s in (b"n", b"v"))
    assert nouns.most_common(1)[0][0] != verbs.most_common(1)[0][0]
    assert nouns.most_common(1)[0][1] > 30 and verbs.most_common(1)[0][1] > 30


def test_no_rows_and_no_training(spark):
    assert classlm.class_model_scores(documents(spark, []), **SMALL).collect() == []
    held = next(i for i in range(100) if not training(i))
    row = classlm.class_model_scores(documents(spark, [(held, "a b")]), **SMALL).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert abs(row.base_score) < 1e-9 and math.isfinite(row.score)
