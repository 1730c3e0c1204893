"""Hard negatives against a plain search over all rows."""

import math
import random

from folioseek.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, id long, a long, score long"


def expected(rows, every=50, low=50, high=95):
    usable = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    def best(found):
        return sorted(found, key=lambda x: (-x[0], x[1]))

    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in usable if i % every == 0}:
        scored = [(sum(map(int.__mul__, v, w)), j, other) for j, other, w in usable]
        for ps, p, _ in best(x for x in scored if x[2] == label and x[1] != i)[:5]:
            fits = [x for x in scored if x[2] != label and low * ps <= 100 * x[0] <= high * ps]
            for rank, (ns, n, _) in enumerate(best(fits)[:3], 1):
                out.append((i, p, rank, n, ps, ns))
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    got = hardneg.mine(table)
    assert got.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return sorted(map(tuple, got.collect()))


def vectors(seed, n, dim=6, labels=3):
    """Small steps, so that many scores are equal."""
    rng = random.Random(seed)
    steps = [x / 16 for x in range(-3, 9)]
    return [(i, [rng.choice(steps) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def test_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "ROWS", 60)
    monkeypatch.setattr(hardneg, "ANCHORS", 4)
    monkeypatch.setattr(hardneg, "FIRST", 16)
    monkeypatch.setattr(hardneg, "SLICE", 2)
    monkeypatch.setattr(hardneg, "HELD", 1)
    rows = vectors(1, 700)
    rows += [(i + 700, rows[3][1], i % 3) for i in range(160)]
    assert len(expected(rows)) > 150
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = vectors(2, 120)
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (250, [1.0] * 6, None), (300, [], 0), (350, [0.5], 1)]
    rows += [(400, [float("nan")] * 6, 0), (450, [None] * 6, 0), (500, [float("inf")] * 6, 0)]
    rows += [(100, rows[0][1], 0), (0, *rows[0][1:]), (-50, rows[9][1], 2), (50, rows[8][1], 1)]
    rows += [(550, [300.0, -70000.5] + [0.1] * 4, 2), (7, [300.0, -70000.5] + [0.1] * 4, 2)]
    rows += [(600, [4e5] * 6, 0), (601, [4e5] * 6, 0), (602, [3e5] * 6, 1)]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


def test_batches_are_bounded(spark):
    """A batch of joined blocks must not hold thousands of them."""
    assert 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= 1 << 28
