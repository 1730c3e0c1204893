"""Runs against all stretches and periods, one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import ODD_ROWS, documents

from folioseek.llm import periodic, queries


def expected(words, least=12):
    """Every maximal stretch of every period, at its smallest period."""
    numbers, found = np.unique(np.array(words, str), return_inverse=True)[1], {}
    for q in range(1, len(words) // 2 + 1):
        same = np.r_[False, numbers[q:] == numbers[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for i, j in zip(edges[::2], edges[1::2], strict=True):
            if j - i >= q:
                found.setdefault((i, j + q - i), q)
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least, 2 * q))


def sequences(seed, count=300):
    rng = random.Random(seed)
    for _ in range(count):
        kind, n = rng.randrange(4), rng.randrange(0, 120)
        if kind == 0:
            yield [rng.randrange(2) for _ in range(n)]
        elif kind == 1:
            yield [rng.randrange(1, 4)] * n
        elif kind == 2:
            part = [rng.randrange(5) for _ in range(rng.randrange(1, 40))]
            yield ([rng.randrange(5) for _ in range(rng.randrange(9))] + part * rng.randrange(1, 9))[:200]
        else:
            a, b = [0], [0, 1]
            while len(b) < n + 1:
                a, b = b, b + a
            yield b[:n]


@pytest.mark.parametrize("least", [2, 12])
def test_against_all_periods(least):
    texts = list(sequences(1))
    for words in texts:
        catcher = periodic.Catcher()
        catcher.append(np.array(words, np.int64))
        assert list(map(tuple, catcher.runs(least).tolist())) == expected(words, least)
    offsets = np.cumsum([0, *map(len, texts)])
    joined = periodic.runs_of_texts(np.array(sum(texts, []), np.int64), offsets, least)
    assert [list(map(tuple, r.tolist())) for r in joined] == [expected(w, least) for w in texts]


def test_word_by_word(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 7)
    rng = random.Random(5)
    for words in sequences(2, 60):
        catcher, i = periodic.Catcher(), 0
        while i < len(words):
            step = rng.choice([1, 1, 1, 2, 9])
            catcher.append(np.array(words[i : i + step], np.int64))
            i += step
            assert list(map(tuple, catcher.runs().tolist())) == expected(words[:i], 2)


def test_names_that_collide(monkeypatch):
    """Unequal windows with equal names change nothing."""
    monkeypatch.setattr(periodic, "_joined", lambda left, right: (left + right) % np.uint64(5))
    for words in sequences(3, 100):
        catcher = periodic.Catcher()
        catcher.append(np.array(words, np.int64))
        assert expected(words) == list(map(tuple, catcher.runs(12).tolist()))


def test_long_repetitive_text():
    n = 400_000
    for words in (np.zeros(n, np.int64), np.arange(n) % 1000):
        catcher = periodic.Catcher()
        catcher.append(words)
        assert catcher.runs().tolist() == [[0, n, 1 if not words.any() else 1000]]


def test_operator_and_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(200)))) for i in range(150)]
    rows += [(200 + i, text) for i, (_, text, *_) in enumerate(ODD_ROWS)]
    rows += [(300, "a b c " * 9 + "x"), (301, "\n".join(["same line here"] * 30)), (None, "z " * 40)]
    rows += [(-7, "a b " * 20), (302, "ab " * 5000)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def answer(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = expected(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        exponent = 1000 * best[1] // best[2] if runs else None
        digests = ["".join(f"{s},{length},{q}\n" for s, length, q in runs)]
        digests.append(" ".join(w for i, w in enumerate(words) if i not in gone))
        return doc_id, len(runs), *best, exponent, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)

    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got))) == sorted(str(answer(*r)) for r in rows)
    assert sum(r.n_runs for r in got) > 10
    empty = documents(spark, [])
    assert periodic.periodic_runs(empty).collect() == []
