import re

import numpy as np

from groundphrase.llm import quality

SCHEMA = "doc_id long, text string, votes string, N_WORDS int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \x0b\n", "a", "a\na\n\na \na", "é\x85é x|y #*", "w " * 40, ("a b c d e f g h " * 2).strip(), "a " * 8, "x " + "a " * 9]
    texts += ["".join(rng.choice(list("ab \n|"), rng.integers(0, 200))) for _ in range(40)]
    texts += [" ".join(rng.choice(["p", "q", "r\n", "s\t"], rng.integers(0, 90))) for _ in range(40)]
    texts.append("one two three four five six seven eight nine ten " * 20_000)
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, "a b", None, 2)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(texts[:-1]):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    assert got[len(texts) - 1].n_repeat_words == 200_000
    assert quality.judge(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_label_model_finds_accuracies():
    rng, n = np.random.default_rng(0), 40_000
    good, right = rng.random(n) < 0.7, np.array([0.9, 0.8, 0.75, 0.95, 0.6])
    ok = rng.random((n, 5)) < right
    votes = np.where(rng.random((n, 5)) < 0.2, "0", np.where(ok == good[:, None], "+", "-"))
    pats, counts = np.unique(["".join(v) for v in votes], return_counts=True)
    start, w = quality.label_model([*zip(pats.tolist(), counts.tolist(), strict=True)])
    odds = start + sum(np.where(votes[:, i] == "+", a, np.where(votes[:, i] == "-", b, 0)) for i, (a, b) in enumerate(w))
    assert ((odds > 0) == good).mean() > 0.93
    assert abs(1 / (1 + np.exp(-start)) - 0.7) < 0.1


def test_held_out_labels(spark):
    """Most texts labelled good are kept, most labelled bad are not; the labels were not used."""
    sf = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    got = quality.op5_quality(spark, sf).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in got if r.label == k] for k in (1, 0))
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.2 * len(bad)
