from itertools import count

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundphrase.operators import providers, semantic


def brute(raw, hint, verdicts, raw_n=2, hint_n=2, cross_n=1, window=8, size=20):
    """One query's ledger, step by step."""
    out, seen, n = [], set(), count(1)
    says = lambda f: verdicts.get(f, "UNCERTAIN")

    def add(f, phase, verdict):
        seen.add(f)
        out.append((next(n), f, phase, verdict))

    done = False
    for f in raw[:raw_n]:
        add(f, "raw-primary", None if done else says(f))
        done = done or says(f) == "SUPPORTED"
    if not done:
        for f in [f for f in hint if f not in seen][:hint_n]:
            add(f, "semantic-hint-rescue", says(f))
            if says(f) == "SUPPORTED":
                done = True
                break
    if not done:
        near = [f for f in raw[:window] if f in hint[:window] and f not in seen]
        near.sort(key=lambda f: (raw.index(f) + hint.index(f), raw.index(f), hint.index(f)))
        for f in near[:cross_n]:
            add(f, "cross-view-consensus-rescue", says(f))
            if says(f) == "SUPPORTED":
                break
    for names, phase in ((raw, "raw-unverified-tail"), (hint, "hint-unverified-tail")):
        for f in names:
            if f not in seen and len(out) < size:
                add(f, phase, None)
    return out


def test_ledger(spark):
    rng = np.random.default_rng(1)
    raws, hints, vs, want = [], [], [], {}
    for q in range(60):
        fams = [f"f{i}" for i in range(12)]
        raw, hint = (rng.permutation(fams)[: rng.integers(0, 11)].tolist() for _ in range(2))
        v = {f: str(rng.choice(["SUPPORTED", "NOT_SUPPORTED", "UNCERTAIN"], p=[0.15, 0.5, 0.35])) for f in fams if rng.random() < 0.9}
        raws += [(q, f, i + 1) for i, f in enumerate(raw)]
        hints += [(q, f, i + 1) for i, f in enumerate(hint)]
        vs += [(q, f, x) for f, x in v.items()]
        want[q] = brute(raw, hint, v, cross_n=2, size=9)
    frame = lambda rows, kind: spark.createDataFrame(rows, f"query_id long, family_id string, {kind}")
    got = {}
    for r in semantic.ledger(frame(raws, "rank long"), frame(hints, "rank long"), frame(vs, "verdict string"), cross_n=2, size=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.family_id, r.phase, r.verdict))
    assert got == {q: w for q, w in want.items() if w}


def test_compose(spark):
    rows = [("PASS_THROUGH", "ATTEST", None, False, None), ("ACCEPT", "ATTEST", None, False, "a\nb"), ("ACCEPT", "EXPLAIN", None, False, "a: x\nb: y"), ("ACCEPT", "SEARCH_BY_MEANING", "draft", True, "draft"), ("ACCEPT", "SEARCH_BY_MEANING", "bad", False, "a\nb")]
    df = spark.createDataFrame(rows, "d string, a string, draft string, ok boolean, want string")
    t, g = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("y"))
    assert all(r.x == r.want for r in df.withColumn("x", semantic.compose(F.col("d"), t, g, F.col("a"), F.col("draft"), F.col("ok"))).collect())


def test_providers(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, ""), (4, None)], "i int, t string")
    v = {r.i: r.v for r in providers.with_vectors(df, "t").collect()}
    assert v[1] == v[2] and all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())
    got = {r.i: (r.answer, r.answer_error) for r in providers.with_model(df, F.col("t"), lambda p: p.upper()).collect()}
    assert got[1] == ("ONE TWO THREE", None) and got[4][1].startswith("AttributeError")
    answers = ['<think>so</think>```json\n{"a": 1, "b": "x"}\n```', '{"a": 1}', "no", '{"a": 1, "b": "x", "c": 2}']
    df = spark.createDataFrame(list(enumerate(answers)), "i int, t string")
    assert [r.x and tuple(r.x) for r in df.select("i", providers.strict_json(F.col("t"), "a int, b string", ["a", "b"]).alias("x")).orderBy("i").collect()] == [(1, "x"), None, None, None]
    providers.snapshot_metadata(str(tmp_path / "m"), "m", ["f1"], 2, "d")
    good = spark.createDataFrame([("f1", [1.0, 0.0])], "family_id string, v array<float>")
    providers.check_snapshot(str(tmp_path / "m"), "m", ["f1"], good)
    with pytest.raises(ValueError):
        providers.check_snapshot(str(tmp_path / "m"), "other", ["f1"], good)
