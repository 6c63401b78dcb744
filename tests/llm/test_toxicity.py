import re
import zlib
from collections import namedtuple

import numpy as np
from pyspark.sql import functions as F

from groundphrase.llm import toxicity as T


def test_label_model_finds_posteriors_and_correlations():
    rng, n = np.random.default_rng(1), 6000
    y = (rng.random(n) < 0.2).astype(int)
    flip = lambda a: np.where(rng.random(n) < a, y, 1 - y)
    one = flip(0.75)
    copy = lambda: np.where(rng.random(n) < 0.95, one, 1 - one)
    votes = np.stack([flip(0.9), flip(0.85), flip(0.8), one, copy(), copy(), np.where(rng.random(n) < 0.5, flip(0.9), -1)], 1)
    p, model = T.label_model(votes)
    assert ((p > 0.5) == y).mean() > 0.93
    # Copies hang on each other; left as if they were independent, they count too much.
    assert sum(model.parent[j] in (3, 4, 5) for j in (3, 4, 5)) == 2
    apart = T.Voters([-1] * 7, [np.broadcast_to(t[:, :1], (2, 3, 3)) for t in T.label_model(votes, rounds=1)[1].tables], model.share)
    lone = np.array([[1, 1, 1, 2, 2, 2, 0]])  # three copies against three voters
    assert model.posterior(lone)[0] < apart.posterior(lone)[0]
    got = model.accuracy(np.where(votes < 0, 0, votes + 1), p)
    assert all(abs(a - b) < 0.08 for (a, _), b in zip(got, (0.9, 0.85, 0.8, 0.75, 0.75, 0.75, 0.9), strict=True))


def test_balance_is_kept():
    votes = np.array([[1, 1], [1, 0], [0, 0], [-1, -1]] * 50)
    assert T.label_model(votes, 0.1)[1].share == 0.1


def brute(model, text):
    """The score of a text, one feature after the other."""
    w = re.findall(r"[^\W\d_]+", text.lower())
    z = model.bias + model.insults * np.log1p(200 * sum(x in T.INSULTS and len(x) > 3 for x in w) / (len(w) + 30))
    for f, weight in model.weights.items():
        n = sum(len(x) > 3 and (x == f or f.endswith("*") and len(x) >= len(f) and x.startswith(f[:-1])) for x in w)
        z += weight * np.log1p(200 * n / (len(w) + 30))
    return 1 / (1 + np.exp(-z))


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = T.learned(spark, "/root/testdata/sf0.01")
    got = T.score(docs, model).collect()
    assert model.weights and all(abs(r.score - brute(model, r.text)) < 1e-9 for r in got)


def test_a_repeated_id_neither_breaks_the_bound_nor_ends_the_sample(spark):
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5][:61]
    toxic = free[0]
    docs = spark.createDataFrame([(toxic, f"text number {k}") for k in range(30)] + [(i, f"other text {i}") for i in free[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == toxic)) for i in free] + [(toxic, 0), (9999, 1)], "doc_id long, toxic int")
    for n in (2, 5, 13, 40, 89, 90, 200):
        got = T.sample(docs, labels, n=n).collect()
        assert len(got) == min(n, 90) and {r.y for r in got} == {0, 1}
        assert abs(sum(r.y for r in got) - len(got) / 3) <= (1 if n >= 61 else n / 3 + 1)


def test_copies_are_weights(spark):
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(free[0], f"text number {k % 3}") for k in range(50)] + [(i, "other text") for i in free[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in free], "doc_id long, toxic int")
    got = T.sample(docs, labels).collect()
    assert len(got) == 50 + len(free) - 1 and len({r.hash for r in got if r.id == free[0]}) == 3
    assert T.fit(T.sample(docs, labels)).bias


def test_weighted_fit_is_that_of_repeated_rows():
    rng, names = np.random.default_rng(3), [f"f{i}" for i in range(20)]
    Row = namedtuple("Row", "y n_words insults patterns copies hits")
    Hit = namedtuple("Hit", "i c")
    docs = [Row(int(rng.random() < 0.3), int(rng.integers(5, 90)), int(rng.integers(0, 2)), [int(x) for x in rng.integers(-1, 2, 3)], int(rng.integers(1, 5)), [Hit(int(i), int(rng.integers(1, 4))) for i in sorted(rng.choice(20, 4, replace=False))]) for _ in range(120)]
    a, b = T._train(docs, names), T._train([r._replace(copies=1) for r in docs for _ in range(r.copies)], names)
    assert abs(a.bias - b.bias) < 1e-3 and a.weights.keys() == b.weights.keys() and all(abs(a.weights[k] - b.weights[k]) < 1e-4 for k in a.weights)


def test_held_out_is_by_crc32(spark):
    ids = [0, 1, 7, 123456, -5, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", T.is_held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = T.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == k] for k in (1, 0))
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.6 * len(toxic)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "an idiot and a moron", "x"), (2, None, "y"), (None, "", None), (1, "an idiot and a moron", "x"), (3, "word " * 200_000, "z")], "doc_id long, text string, SCORE string")
    none = spark.createDataFrame([(1, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = T.fit(T.sample(docs, none))
    got = {(r.doc_id, r.text and len(r.text)): r.score for r in T.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[1, 20] > 0.5 > got[2, None]
    assert T.score(docs, model).count() == 5 and T.score(docs.limit(0), model).count() == 0
