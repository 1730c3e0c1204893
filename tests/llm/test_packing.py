"""Both packings give back every id; windows keep the sources' proportions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD_ROWS, documents, prose

from folioseek.llm import bestfit, mixture
from folioseek.llm.queries import tokenizer_path
from folioseek.llm.tokens import WordTokens

pytest.importorskip("public_tokenizers")


def plain_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = list(ODD_ROWS) + [(50, "a<|endoftext|>b <|startoftext|> x\x1cy it's 'tis é")]
    return out + [(100 + i, prose(i, rng.randint(1, 700)), "en", f"s{i % 3}") for i in range(60)]


def test_words_are_encoded_as_texts_are(rows):
    texts = [r[1] for r in rows] + ["don't STOP... 12,000% ﬁne x"]
    for limit in (5, 1000):
        encoded = WordTokens(tokenizer_path(), limit=limit).encode(texts)
        assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == [plain_ids(t)[:-1] for t in texts]


def test_mixture(spark, rows):
    pieces = mixture.pack_mixture(documents(spark, rows), tokenizer_path(), size=256).collect()
    wanted = defaultdict(list)
    for i, text, *_ in rows:
        wanted[i].append(plain_ids(text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(wanted)
    for i, texts in wanted.items():
        if len(texts) == 1:
            (ids,) = texts
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part))
                at += p.length
            assert at == len(ids)
        else:
            assert sum(p.length for p in by_doc[i]) == sum(map(len, texts))
    lengths = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        lengths.append(at)
    assert set(lengths[:-1]) == {256} and sorted(by_sequence) == list(range(len(lengths)))


@pytest.mark.parametrize(
    "totals, weights",
    [
        ({"a": 100_000, "b": 37_001, "c": 5}, None),
        ({"a": 90_000, "b": 50_000, "c": 999}, {"a": 1, "b": 1, "c": 0.01}),
        ({"a": 10, "b": 0}, {"b": 2}),
        ({"a": 3}, None),
        ({}, None),
        ({f"s{i}": 100 + 37 * i for i in range(50)}, None),
    ],
)
def test_schedule_places_every_token_once(totals, weights):
    plan = mixture.make_schedule(totals, weights, size=128, period=16)
    columns = defaultdict(set)
    shares = defaultdict(lambda: defaultdict(int))
    for source, n in totals.items():
        for a in range(0, n, 997):
            k = min(997, n - a)
            start, length, sequence, offset = mixture.pieces_of(plan, source, a, k)
            assert start[0] == 0 and start[-1] + length[-1] == k and (np.diff(start) == length[:-1]).all()
            for s, o, m in zip(sequence.tolist(), offset.tolist(), length.tolist(), strict=True):
                new = set(range(o, o + m))
                assert not columns[s] & new and o + m <= 128
                columns[s] |= new
                shares[s][source] += m
    filled = [len(columns[s]) for s in sorted(columns)]
    assert sum(filled) == sum(totals.values()) and all(f == 128 for f in filled[:-1])
    if plan.phases:
        first, whole = plan.phases[0], sum((weights or totals).values())
        for s in range(first.windows):
            for source in first.sent:
                target = 128 * (weights or totals)[source] / whole
                assert abs(shares[s][source] - target) < 3


def test_best_fit(spark, rows):
    found = bestfit.pack_best_fit(documents(spark, rows), tokenizer_path(), size=128).collect()
    parts, used, n = defaultdict(list), 0, 0
    for m in found:
        ids = np.frombuffer(m.ids, "<u2").reshape(m.n_rows, 128)
        for r in range(m.n_rows):
            ends = m.cu_seqlens[r]
            assert ends[0] == 0 and ends[-1] <= 128 and m.resets[r] == ends[:-1]
            assert (ids[r, ends[-1] :] == 0).all()
            for k, (doc, start) in enumerate(zip(m.doc_ids[r], m.starts[r], strict=True)):
                parts[doc].append((start, ids[r, ends[k] : ends[k + 1]].tolist()))
            used, n = used + ends[-1], n + 1
    once = {i for i, *_ in rows if sum(r[0] == i for r in rows) == 1}
    for i, text, *_ in rows:
        if i in once:
            assert sum((p for _, p in sorted(parts[i])), []) == plain_ids(text)
    assert used == sum(len(plain_ids(r[1])) for r in rows) and used / n / 128 > 0.95
    assert len({m.matrix_id for m in found}) == len(found)


def test_tightest_row_is_found():
    rng = random.Random(0)
    tree, rooms = bestfit.CapacityTree(100), {}
    for row in range(3000):
        need = rng.randint(1, 100)
        fitting = [r for r in rooms.values() if r >= need]
        found = tree.take(need)
        assert (found and found[0]) == (min(fitting) if fitting else None)
        if found:
            del rooms[found[1]]
        else:
            room = rng.randint(1, 100)
            tree.add(room, row)
            rooms[row] = room


def test_empty(spark):
    none = documents(spark, [])
    assert mixture.pack_mixture(none, tokenizer_path()).collect() == []
    assert bestfit.pack_best_fit(none, tokenizer_path()).collect() == []
