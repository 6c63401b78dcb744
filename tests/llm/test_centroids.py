import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from groundphrase.llm import centroids as ce


def brute(rows, k=16, rounds=3, n=64):
    kept = [(i, [math.floor(64 * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", ce.pack(np.array([[x / 64 for x in r[1]]]))[0]))[:k]
    c = [v for _, v in starts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (dist(v, c[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(kept, of, strict=True) if o == j]:
                c = [*c[:j], [sum(x) // len(mine) for x in zip(*mine, strict=True)], *c[j + 1 :]]
    out = [(i, near(v), dist(v, c[near(v)])) for i, v in kept]
    per = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, fit(d), fit(per[j]), fit(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, vec string, n int")
    return sorted(map(tuple, ce.cluster(df, **more).collect()), key=str)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.normal(0, 0.2, 64))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1])] * 5  # copies, repeated rows
    rows += [(None, rows[5][1]), (None, f32(rng.normal(0, 5, 64)))]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] * 64), (906, [None] + [0.0] * 63)]
    assert got(spark, rows + bad) == brute(rows + bad)


def test_ties_and_empty_centroids(spark):
    base = [[0.0] * 63 + [x / 64] for x in (0, 2, 4)]
    rows = [(i, base[i % 3]) for i in range(30)] + [(40, [0.0] * 63 + [1 / 64]), (41, [0.0] * 63 + [3 / 64])]  # halfway between centroids
    res = got(spark, rows)
    assert res == brute(rows)
    assert len({r[1] for r in res}) < 16


def test_few_rows_and_none(spark):
    assert got(spark, [(1, [0.5] * 64), (2, [-0.5] * 64)]) == brute([(1, [0.5] * 64), (2, [-0.5] * 64)])
    assert got(spark, []) == [] == got(spark, [(1, [1.0] * 3)])


def test_huge_components_are_exact(spark):
    rows = [(i, f32([(-1) ** i * 1e30 * (1 + i / 7)] * 32 + [3e38] + [0.01 * i] * 31)) for i in range(24)] + [(50 + i, f32([70000.0 * i] * 64)) for i in range(6)]
    res = got(spark, rows)
    assert res == brute(rows)
    assert any(r[4] is None for r in res)


@pytest.mark.parametrize("x", [0, 5, -5, (1 << 200) + 3, -(1 << 90)])
def test_digits(x):
    assert sum(d << ce.DIGIT * p for p, d in ce.digits(x)) == x
    assert all(abs(d) < 1 << ce.DIGIT for _, d in ce.digits(x))


def test_forms_are_canonical():
    v = np.array([[0.0] * 64, [1.99] * 64, [3.0] * 64, [1000.0] * 64, [1e9] * 64])
    forms = ce.pack(v)
    assert [f[:1] for f in forms] == [b"b", b"b", b"h", b"i", b"t"]
    assert [ce.unpack(f)[0] for f in forms] == [0, 127, 192, 64000, 64 * 10**9]
    assert Counter(map(len, forms))[65] == 2
