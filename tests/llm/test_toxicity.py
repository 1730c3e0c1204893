"""The kernel against its definition; accuracy on held-out texts; odd rows."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from helpers import ODD_ROWS, documents, prose

from folioseek.llm import toxicity

INSULTS = ["grumblok", "snivelwit", "trogface", "mudbrain"]


def kernel(a, b):
    total = 0.0
    for x in combinations(range(len(a)), toxicity.LENGTH):
        for y in combinations(range(len(b)), toxicity.LENGTH):
            if all(a[i] == b[j] for i, j in zip(x, y, strict=True)):
                total += toxicity.DECAY ** (x[-1] - x[0] + 1 + y[-1] - y[0] + 1)
    return total


def test_kernel():
    words = ["abcab", "moron", "mxoron", "abc", "ab", "zzzzz", "aaaa", "éàüéàü"]
    for other in words:
        got = toxicity.subsequence_kernel(toxicity._codes(words), toxicity._codes([other]))
        assert np.allclose(got, [kernel(w, other) for w in words], rtol=1e-4)


def test_bound_never_lies():
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(3, 12))) for _ in range(300)]
    marks = [toxicity.Landmark(w) for w in words[:20]]
    got = {(i, j): v for i, j, v in zip(*(x.tolist() for x in toxicity.similarities(words, marks)), strict=True)}
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            value = kernel(w, m.word) / np.sqrt(kernel(w, w) * kernel(m.word, m.word))
            if value > toxicity.FLOOR + 1e-4:
                assert got[i, j] == pytest.approx(value, rel=1e-3)
            elif value < toxicity.FLOOR - 1e-4:
                assert (i, j) not in got


def test_words_and_parts():
    assert {"a.b", "cd", "xyz"} <= toxicity.words_of("A.b  CD\nx y z")
    assert toxicity.letters_of("i.d-1iot") == ["idiot"]
    long = "abcdefghij" * 7
    parts = toxicity.letters_of(long)
    assert all(len(p) <= toxicity.REACH for p in parts)
    assert all(any(long[a : a + 8] in p for p in parts) for a in range(len(long) - 7))


def spoilt(word, rng):
    at = rng.randrange(2, len(word) - 2)
    return rng.choice([word[:at] + "-" + word[at:], word[:at] + rng.choice("aeiou") + word[at:], word.upper() + "!"])


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(100, 420):
        words = prose(i, rng.randint(20, 120)).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            insult = rng.choice(INSULTS)
            words.insert(rng.randrange(len(words)), spoilt(insult, rng) if rng.random() < 0.5 else insult)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    labels += [(100, 1, 1), (7000, 0, 1), (None, 0, 1), (101, 0, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return [*ODD_ROWS, *rows], table


def test_held_out_accuracy_and_odd_rows(spark, case):
    rows, labels = case
    docs = documents(spark, rows)
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(
        r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found
    )
    held = [r for r in found if r.held_out and r.doc_id >= 100]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert not any(r.predicted for r in found if r.doc_id is None or r.doc_id < 100)


def test_held_out_labels_change_nothing(spark, case):
    rows, labels = case
    docs = documents(spark, rows)
    known = labels.filter(toxicity.is_training(labels.doc_id))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, known)
    assert a.landmarks == b.landmarks and np.allclose(a.weights, b.weights)


def test_sample_bound_and_missing_classes(spark, case):
    rows, labels = case
    docs = documents(spark, rows)
    assert toxicity._sample(docs, labels, 10).count() in (18, 19, 20)
    none = labels.filter("toxic = 0")
    for part in (none, none.limit(0)):
        found = toxicity.score(docs, toxicity.fit(docs, part)).collect()
        assert len(found) == len(rows) and not any(r.predicted for r in found)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(documents(spark, []), model).collect() == []
