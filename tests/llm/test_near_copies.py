"""The near-duplicate stage of the pipeline against the Jaccard similarity of all pairs."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from groundphrase.llm import near_copies

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i, (d, t) in enumerate(rows):
        out.setdefault(find(i), []).append((d is None, d, t))
    return sorted((min(v)[1] for v in out.values()), key=str)


def changed(rng, base, n):
    w = base.split()
    for at in rng.choice(len(w), n, replace=False):
        w[at] = f"x{rng.integers(1_000_000)}"
    return " ".join(w)


@pytest.mark.parametrize("tile", [1 << 18, 300])  # in one tile, and in many
def test_jaccard_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    rows = []
    for g in range(12):  # near copies of every similarity, and chains of them
        base = word(int(rng.integers(60, 400)))
        rows += [(100 * g + i, changed(rng, base, int(n))) for i, n in enumerate([0, *rng.integers(0, 12, 14)])]
    passage = word(50)  # in many texts, and too little to link them
    rows += [(5000 + i, f"{passage} {word(40)}") for i in range(60)]
    rows += [(6000, ""), (6001, " \t"), (6002, "short one"), (6003, "Short  one"), (6004, "short two")]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], SCHEMA).repartition(3)
    got = sorted((r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == brute(rows) and len(got) < len(rows) - 80


def test_shared_and_null_ids(spark):
    rng = np.random.default_rng(6)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(4))
    rows = [(1, a), (1, b), (2, c), (None, changed(rng, c, 1)), (None, d), (None, changed(rng, d, 1)), (1, a)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.text for r in got if r.doc_id is not None) == sorted([a, b, c])
    assert [r.text in (d, rows[5][1]) for r in got if r.doc_id is None] == [True]
