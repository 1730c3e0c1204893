"""Fingerprints and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from helpers import ODD_ROWS, documents, prose

from folioseek.llm import simhash
from folioseek.llm.components import components
from test_quality import WORD


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_documents(spark):
    rng = random.Random(3)
    rows = [r for r in ODD_ROWS if r[0] is not None]
    for i in range(40):
        words = prose(i % 8, 300).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(300)] = "Changed"
        rows.append((100 + i, " ".join(words)))
    found = simhash.near_components(documents(spark, [*rows, (None, "no id")])).collect()
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    ids = sorted({i for i, _ in prints})
    links = [(a, b) for a, p in prints for b, q in prints if (p ^ q).bit_count() <= 2]
    root = groups(links, ids)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in found if r.doc_id is not None)
    assert got == sorted((i, p, root[i]) for i, p in prints)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert len(set(root.values())) < len(ids) - 15


@pytest.mark.parametrize("seed", range(3))
def test_links_of_close_fingerprints(spark, seed):
    """Nothing is missed among fingerprints that differ in few bits, nor said twice."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = set(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = [(r.u, r.v) for r in simhash.near_links(table).collect()]
    wanted = {
        (a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2
    }
    assert len(got) == len(set(got)) and set(got) == wanted


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (50, 51), (51, 50)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = components(spark.createDataFrame(links, "u long, v long"))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in found.collect()} == groups(links, nodes)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    values = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.int64)
    counts = simhash._bit_counts(values, np.array([0, 0, 20, 20]), np.array([0, 20, 20, 50]))
    assert counts[0].sum() == counts[2].sum() == 0
    assert all(counts[3][b] == sum(int(v) >> b & 1 for v in values[20:]) for b in range(64))


def test_keep_first(spark):
    rows = [(5, prose(1, 90)), (3, prose(1, 90)), (8, prose(2, 90)), (8, prose(2, 90)), (None, prose(1, 90))]
    rows += [(8, prose(3, 90)), (None, prose(4, 90)), (None, prose(5, 90)), (None, prose(5, 90))]
    docs = documents(spark, rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    wanted = [(3, 1), (8, 2), (8, 3), (None, 4), (None, 5)]
    found = sorted((str(r.doc_id), r.text) for r in kept.collect())
    assert found == sorted((str(i), prose(seed, 90)) for i, seed in wanted)
    assert simhash.keep_first(documents(spark, [])).collect() == []
