"""Base spans against the patterns as written; the model against held-out spans."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import ODD_ROWS, documents, prose

from folioseek.llm import pii, queries

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [c for c in m[0] if c in "0123456789"]
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2:
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_rules_on_random_marks():
    rng = random.Random(0)
    pieces = ["1", "25", "255", "256", "4111111111111111", ".", ".", "@", "+", " ", "-", "a", "x.y", "(", ")", "é", "\n", "007"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain_base(text), text
    for n in range(300):
        text = f"a.b@c.d{n} +1 (555) 555-01{n:02} 10.0.{n}.7 {4111111111111000 + n} a@b@c.de_f@g.h"
        assert pii.base_spans(text) == plain_base(text)


def test_long_runs():
    """A run of a million marks takes no more than some passes."""
    for mark in ("a", "1", ".", "@", "+", "1.", "a@", "1 ", "+1 ", "a.", "-", "a@b."):
        text = mark * (1_000_000 // len(mark))
        assert len(pii.base_spans(text)) <= 500_000


@pytest.fixture(scope="module")
def model():
    places = [(prose(i, 30), []) for i in range(60)]
    return pii.train(*pii.training_set(places, 4000))


def test_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pii._start_weights(rng).items()}
    x, y = rng.integers(0, pii.CLASSES, (3, 7)), rng.integers(0, 5, (3, 7))
    _, grad = pii.loss_and_gradient(w, x, y)
    for k, v in w.items():
        at = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
        sides = []
        for step in (1e-2, -1e-2):
            other = {**w, k: v.copy()}
            other[k][at] += step
            sides.append(pii.loss_and_gradient(other, x, y)[0])
        assert abs((sides[0] - sides[1]) / 2e-2 - grad[k][at]) < 1e-3, k


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    model = pii.Model({"moves": rng.normal(0, 1, (5, 5))})
    scores = rng.normal(0, 1, (4, 5, 6)).astype(np.float32)
    paths = np.array(np.meshgrid(*[range(5)] * 4)).reshape(4, -1).T
    found = model.decode(scores)
    for n in range(6):
        totals = [
            sum(scores[t, p[t], n] for t in range(4)) + sum(model.weights["moves"][p[t], p[t + 1]] for t in range(3))
            for p in paths
        ]
        assert tuple(found[n]) == tuple(paths[int(np.argmax(totals))])


def test_held_out_tags(model):
    places = [(prose(1000 + i, 30), []) for i in range(60)]
    x, y = pii.training_set(places, 500, seed=77)
    tags = model.decode(model.emissions(x))
    assert (tags == y)[x > 0].mean() > 0.97


def test_added_spans(model):
    text = (
        f"{prose(1, 60)} write to jane.doe [at] mail dot example dot com {prose(2, 60)} at 10 . 0 . 0 . 17 "
        f"{prose(3, 60)} card 4111/1111/1111/1111 {prose(4, 90)} (212) 555-0147 {prose(5, 60)}"
    )
    found = {(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans(model, [text], [[]])[0]}
    assert len(found) >= 3
    assert found <= {
        ("email", "jane.doe [at] mail dot example dot com"),
        ("ip", "10 . 0 . 0 . 17"),
        ("card", "4111/1111/1111/1111"),
        ("phone", "(212) 555-0147"),
    }
    clean = [prose(i, 500) for i in range(40)]
    assert not any(pii.added_spans(model, clean, [[] for _ in clean]))


def test_windows_reconciled():
    text = "x" * 5 + "a @ b.example.com" + " y" * 5 + " 10 . 0 . 0 . 7"
    at = text.index("10 .")
    pieces = [(0, 5, 14, 3.0), (0, 10, 22, 4.0), (1, at, at + 9, 1.0), (1, at + 5, len(text), 2.0), (2, 0, 9, 9.0)]
    assert pii.reconciled(text, [], pieces)[1:] == [(at, 1, len(text))]
    assert pii.reconciled(text, [(at, 1, at + 2)], pieces[2:4]) == []


def test_query(spark, tmp_path):
    rows = [(i, prose(i, 40)) for i in range(40)] + [(100 + i, t) for i, (_, t, *_) in enumerate(ODD_ROWS)]
    rows += [(200, "a.b@c.example.com, 10.0.0.7; 4111 1111 1111 1111 or +1 (212) 555-0147"), (None, "x@y.zz")]
    rows += [(201, "\U0001f600 é 10.0.0.7" + " z" * 400 + " me@here.example.org")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    wanted, found = [], []
    for doc_id, text, *_ in rows:
        base = plain_base(text or "")
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        counts = [sum(k == n for _, k, _ in base) for n in range(4)]
        wanted.append(str((doc_id, counts, hashlib.sha256(spans.encode()).hexdigest(), spans)))
    for r in got:
        own = ",".join(x for x in r.spans.split(",") if not x.startswith("near_"))
        found.append(str((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, own)))
    assert sorted(found) == sorted(wanted)
    empty = documents(spark, [])
    assert pii.find_spans(empty, pii.fit(empty, windows=128)).collect() == []
    nothing = documents(spark, [(1, None), (1, "")])
    assert [r.spans for r in pii.find_spans(nothing, pii.fit(nothing, windows=128)).collect()] == [[], []]
