"""Removed bytes against all strings of fifty bytes."""

import hashlib
import random

import numpy as np
import pytest
from helpers import LONG, ODD_ROWS, documents, prose

from folioseek.llm import bwtdedup

SPAN = bwtdedup.SPAN


def expected(rows):
    first = {}
    for i, text in rows:
        raw, own = (text or "").encode(), float("inf") if i is None else i
        for k in range(len(raw) - SPAN + 1):
            s = raw[k : k + SPAN]
            first[s] = min(first.get(s, own), own)
    out = []
    for i, text in rows:
        raw, own = (text or "").encode(), float("inf") if i is None else i
        gone = bytearray(len(raw))
        for k in range(len(raw) - SPAN + 1):
            if first[raw[k : k + SPAN]] < own:
                gone[k : k + SPAN] = b"\1" * SPAN
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((str(i), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(4)
    passage = prose("passage", 40)
    rows = [(r[0], r[1] if r[1] != LONG else LONG[:4000]) for r in ODD_ROWS]
    for i in range(30):
        text = prose(i % 20, 60)
        if i % 3 == 0:
            a = rng.randint(0, 100)
            text = f"{text[:a]} {passage[rng.randint(0, 9):rng.randint(80, 200)]} {text[a:]}"
        rows.append((rng.choice([i, 500 - i]), text))
    rows += [(600, "é" * 60), (601, "x" + "é" * 60), (602, "z" * 300), (603, "z" * 200), (604, passage * 3)]
    edited = list(prose(1, 60))
    for at in (60, 100, 140, 180):
        edited[at] = "#"
    return [*rows, (700, "".join(edited)), (701, passage[:49]), (702, passage[:50]), (None, passage)]


@pytest.mark.parametrize("chunk, buckets, step", [(4 << 20, 16 << 20, 1 << 20), (900, 700, 300)])
def test_against_brute_force(spark, monkeypatch, chunk, buckets, step):
    for name, value in (("CHUNK", chunk), ("BUCKET_BYTES", buckets), ("STEP", step)):
        monkeypatch.setattr(bwtdedup, name, value)
    rows = cases()
    found = bwtdedup.remove_repeats(documents(spark, [(i, t) for i, t in rows])).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == expected(rows)


def test_every_window_has_an_anchor():
    rng = random.Random(0)
    for alphabet in (b"ab", bytes(range(256))):
        texts = [bytes(rng.choices(alphabet, k=n)) for n in (0, 49, 50, 51, 400, 300)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        place = bwtdedup.anchors(data, np.array([len(t) for t in texts]))[0]
        at = 0
        for t in texts:
            for k in range(at, at + len(t) - SPAN + 1):
                assert np.any((place >= k) & (place <= k + SPAN - bwtdedup.K))
            at += len(t)


def test_columns_against_pairs():
    rng = np.random.default_rng(2)
    m = 60
    strings = rng.integers(97, 99, (m, bwtdedup.WIDTH)).astype(np.uint8)
    strings[:, 20:65] = 97
    strings[: m // 2, :] = strings[0]
    group, doc = rng.integers(0, 3, m), rng.integers(0, 9, m)
    left, right = rng.integers(0, bwtdedup.LEFT + 1, m), rng.integers(20, SPAN + 1, m)
    mask = bwtdedup.equal_windows(group, doc, strings, left, right)
    for i in range(m):
        for c in range(bwtdedup.LEFT + 1):
            def has(j, c=c):
                return bwtdedup.LEFT - left[j] <= c and c + SPAN <= bwtdedup.LEFT + right[j]

            wanted = has(i) and any(
                group[j] == group[i] and doc[j] < doc[i] and has(j)
                and (strings[i, c : c + SPAN] == strings[j, c : c + SPAN]).all()
                for j in range(m)
            )
            assert bool(int(mask[i]) >> c & 1) == wanted


def test_empty(spark):
    assert bwtdedup.remove_repeats(documents(spark, [])).collect() == []
