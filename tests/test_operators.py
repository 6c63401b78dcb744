import hashlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundphrase.operators import decide, dense, evaluate, index, lexical, local, store
from groundphrase.sources import files
from groundphrase.streaming import requests as streaming

VARIANTS = [(0, "f1", "the early bird catches the worm"), (1, "f1", "early bird catches worm"), (2, "f2", "a stitch in time saves nine"), (3, "f3", "the early bird sings all the day"), (4, "f4", "all that glitters")]


@pytest.fixture()
def variants(spark):
    return spark.createDataFrame(VARIANTS, "doc_id long, family_id string, text string")


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_exact_suppresses_partial(spark, variants):
    got = lexical.surface(ask(spark, "All that GLITTERS!", "stitchintime", "nothing here", ""), variants).collect()
    assert {(r.query_id, r.doc_id, r.score) for r in got} == {("q0", 4, 1.0), ("q1", 2, 0.99)}


def test_golden_numbers(spark):
    two = spark.createDataFrame([(0, "abc"), (1, "xyz")], "doc_id long, text string")
    assert index.trigram_index(two).where("gram = 'abc'").first().idf == pytest.approx(0.693147, abs=1e-6)
    assert index.token_index(two).where("token = 'abc'").first().idf == pytest.approx(0.693147, abs=1e-6)
    one = spark.range(1).select(lexical.noisy_or(tfidf=F.lit(0.5), coverage=F.lit(1.0), bm25=F.lit(0.0)).alias("x")).first().x
    assert one == pytest.approx(0.65)


def test_fuzzy_rerank_and_alignment(spark, variants):
    q = ask(spark, "th erly brd catchs the wrm", "he said: a stich in time saves nine, you know")
    ranked = index.ranked(lexical.fused(q, variants))
    best = {r.query_id: r for r in local.fuzzy_rerank(ranked, q, variants).where("rank = 1").collect()}
    assert best["q0"].doc_id == 0 and best["q0"].fuzzy > 0.8
    top = {(r.query_id, r.doc_id): r for r in local.align(ranked, q, variants).collect()}
    assert top["q1", 2].text == "in time saves nine" and top["q1", 2].score > 0.72  # the longest window without a slip


def test_mentions_are_bound_one_after_another(spark, variants, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = local.bind_mentions(ask(spark, "compare a stitch in time saves nine with all that glitters please"), variants, 2).collect()
    assert {r.family_id for r in got} >= {"f2", "f4"} and len({(r.query_id, r.round) for r in got}) == len(got)


def test_gate(spark):
    values = ["SUPPORTED", "NOT_SUPPORTED", "UNCERTAIN", None]
    df = spark.createDataFrame([*product(values, values)], "p string, v string")
    for r in df.withColumn("g", decide.gate(F.col("p"), F.col("v"))).collect():
        want = "UNCERTAIN" if r.p is None else r.p if r.p != "SUPPORTED" else "SUPPORTED" if r.v == "SUPPORTED" else "UNCERTAIN"
        assert r.g == want


def test_plan_rules(spark):
    rows = [("GENERAL", [], None, None, None, None), ("GENERAL", ["ATTEST"], "x", None, None, "actions-without-route"), ("FFE_REQUIRED", [], None, None, None, "route-without-actions"), ("FFE_REQUIRED", ["EXPLAIN"], None, None, None, "span-action-without-target"), ("FFE_REQUIRED", ["SEARCH_BY_MEANING"], None, None, None, "search-without-description"), ("FFE_REQUIRED", ["RETRIEVE_EXAMPLES"], None, "m", 0, "examples-without-count"), ("FFE_REQUIRED", ["ATTEST", "EXPLAIN"], "t", None, None, None)]
    df = spark.createDataFrame(rows, "route string, actions array<string>, target string, semantic string, n int, want string")
    got = df.withColumn("got", decide.plan_violation(*(F.col(c) for c in ("route", "actions", "target", "semantic", "n")))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_cosine_topk_against_numpy(spark):
    rng = np.random.default_rng(0)
    d, q = rng.normal(size=(300, 8)).astype("float32"), rng.normal(size=(7, 8)).astype("float32")
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id long, v array<float>").repartition(5)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, v array<float>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in dense.cosine_topk(qs, docs, 5, n_queries_block=3).collect()}
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sims = unit(q) @ unit(d).T
    for i in range(7):
        assert [got[i, k + 1] for k in range(5)] == np.argsort(-sims[i], kind="stable")[:5].tolist()
    assert dense.cosine_topk(qs, docs, 0).count() == 0
    with pytest.raises(Exception, match="zero vector"):
        dense.cosine_topk(qs, spark.createDataFrame([(1, [0.0] * 8)], "doc_id long, v array<float>"), 1).collect()


def test_distribution_and_bootstrap(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", 7.0), ("b", float("nan")), ("b", float("inf"))], "g string, v double")
    got = {r.g: r for r in evaluate.distribution(df, "v", ["g"]).collect()}
    assert (got["a"].n, got["a"].median, got["a"].min, got["a"].max) == (5, 3.0, 1.0, 5.0)
    assert (got["b"].n, got["b"].stdev) == (1, 0.0)
    cases = df.where("g = 'a'").withColumn("o", F.col("v"))
    one, two = ([tuple(r) for r in evaluate.bootstrap_groups(cases, "g", "v", "o", iterations=100, seed=7).collect()] for _ in range(2))
    assert one == two and one[0][1:3] == (5, 3.0) and one[0][3] <= 3 <= one[0][4]
    assert one[0][1:] == tuple(evaluate.bootstrap([1, 2, 3, 4, 5], iterations=100, seed=7).values())
    assert evaluate.bootstrap([]) == {"n": 0, "estimate": None, "low": None, "high": None}
    assert evaluate.binomial_p(9, 1) == pytest.approx(22 / 1024)


def test_the_limit_of_resampling_medians(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=900).round(4).tolist()
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 1.0), ("c", None)], "g string, v double")
    got = {r.g: r for r in evaluate.bootstrap_ci(df, "g", "v").collect()}
    seeded = evaluate.bootstrap(values, iterations=2000)
    assert got["a"].estimate == pytest.approx(seeded["estimate"]) and (got["b"].n, got["b"].low, got["b"].high) == (2, 1.0, 1.0) and "c" not in got
    assert abs(got["a"].low - seeded["low"]) < 0.03 and abs(got["a"].high - seeded["high"]) < 0.03


def test_running_counts_cross_ranges(spark):
    rows = [(g, v, int(n)) for g in ("a", None) for v, n in enumerate(np.random.default_rng(4).integers(1, 9, 500))]
    df = spark.createDataFrame(rows, "g string, v int, n long")
    for by in (["g"], None):
        counts = df if by else df.groupBy("v").agg(F.sum("n").alias("n"))
        got, total = {(r["g"] if by else 0, r.v): r.before for r in store.before(counts, "v", "n", by).collect()}, {}
        for r in sorted(counts.collect(), key=lambda r: r.v):
            key = r["g"] if by else 0
            assert got[key, r.v] == total.get(key, 0)
            total[key] = total.get(key, 0) + r.n


def test_families_by_blocks(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(60, 4)).tolist()
    docs = spark.createDataFrame([(i, f"f{i % 7}", v) for i, v in enumerate(m)] + [(100, "f0", None), (101, None, m[0]), (50, "f1", m[3])], "doc_id long, family_id string, v array<float>").repartition(3)
    qs = spark.createDataFrame([(i, m[i]) for i in (3, 4)] + [(9, None)], "query_id long, v array<float>")
    got = {(r.query_id, r.family_id): (r.view, round(r.sim, 6)) for r in dense.cosine_families(qs, docs, n_queries_block=2).collect()}
    unit = np.array(m, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (3, 4):
        for f in range(7):
            mine = [i for i in range(60) if i % 7 == f]
            sims = [round(float(unit[q] @ unit[i]), 6) for i in mine]
            if f == 1:
                continue
            assert got[q, f"f{f}"] == (mine[int(np.argmax(sims))], max(sims))
    assert got[3, "f3"][0] == 3 and got[3, "f1"] == (50, 1.0) and len(got) == 14


def test_review_values(spark):
    df = spark.createDataFrame([("yes ",), ("N",), (None,), ("n/a",)], "v string")
    assert [r.x for r in df.select(evaluate.review(F.col("v")).alias("x")).collect()] == ["YES", "NO", "NA", "NA"]
    with pytest.raises(Exception, match="not a review value"):
        spark.createDataFrame([("maybe",)], "v string").select(evaluate.review(F.col("v"))).collect()


def expression(k, *texts, gloss="A gloss that is long enough to stand."):
    return {"expression_id": f"p{k:04d}", "family_id": f"f{k:04d}", "expression_type": "fixed_expression", "gloss": gloss, "canonical_variant_id": f"p{k:04d}-v1", "variants": [{"variant_id": f"p{k:04d}-v{i}", "text": t, "source_id": "s1", "source_ref": ""} for i, t in enumerate(texts, 1)]}


def test_corpus_files(spark, tmp_path):
    src = spark.createDataFrame([("s1", "book", "free", "2020", "page 1", "known", "human-reviewed")], files.SCHEMAS["sources"])
    good = spark.createDataFrame([expression(1, "one two", "one too"), expression(2, "three four")], files.SCHEMAS["expressions"])
    files.write_jsonl(good, str(tmp_path / "e"))
    back = files.read_jsonl(spark, str(tmp_path / "e"), files.SCHEMAS["expressions"])
    assert files.corpus_violations(back, src).count() == 0
    assert {r.source_ref for r in files.variants_of(back, src).collect()} == {"page 1"}
    bad = spark.createDataFrame([expression(1, "one two", gloss="short"), expression(1, "One  TWO!"), expression(3, "a (b)")], files.SCHEMAS["expressions"])
    assert {r.violation for r in files.corpus_violations(bad, src).collect()} == {"gloss", "duplicate-expression", "duplicate-family", "duplicate-variant", "duplicate-surface", "editorial-marker"}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\n{"id": "x", "b": 2}\n')
    assert [r.problem for r in files.jsonl_errors(spark, str(tmp_path / "x.jsonl"), "id string").collect()] == ["missing id", "not an object", "unknown b"]
    (tmp_path / "r.csv").write_bytes("﻿id,notes\n1,\"two\nlines\"\n".encode())
    assert [tuple(r) for r in files.read_review_csv(spark, str(tmp_path / "r.csv")).collect()] == [("1", "two\nlines")]
    files.write_csv([good.select("expression_id", "variants"), src.select("source_id")], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["expression_id", "variants", "source_id"]
    files.write_one_json(src, str(tmp_path / "one.json"))
    with pytest.raises(ValueError):
        files.write_one_json(good, str(tmp_path / "two.json"))
    assert files.file_hashes(spark, str(tmp_path / "x.jsonl")).first().sha256 == hashlib.sha256((tmp_path / "x.jsonl").read_bytes()).hexdigest()


def test_streamed_requests_go_on_after_a_restart(spark, variants, tmp_path):
    schema = "query_id string, ts timestamp, text string"
    feed = lambda k, *rows: spark.createDataFrame([*rows], "query_id string, ts string, text string").selectExpr("query_id", "timestamp(ts) as ts", "text").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        s = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        streaming.write(streaming.attested(s, variants), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return {r.query_id: (r.status, r.doc_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}, spark.read.parquet(str(tmp_path / "out")).count()

    feed(1, ("a", "2024-01-01 00:00:00", "All that glitters"), ("a", "2024-01-01 00:00:10", "All that glitters"), ("b", "2024-01-01 00:01:00", "x"))
    assert run() == ({"a": ("ATTESTED", 4), "b": ("NEEDS_CLARIFICATION", None)}, 2)
    feed(2, ("a", "2024-01-01 00:02:00", "again"), ("c", "2024-01-01 00:03:00", "not in the corpus"))
    assert run() == ({"a": ("ATTESTED", 4), "b": ("NEEDS_CLARIFICATION", None), "c": ("NOT_ATTESTED", None)}, 3)


def test_engine_end_to_end(spark):
    from groundphrase.operators.engine import Engine, Policy, factory

    variants = spark.createDataFrame(VARIANTS, "doc_id long, family_id string, text string")
    glosses = spark.createDataFrame([(1, "f1", "سحرخیز باش تا کامروا شوی"), (2, "f2", "کار را زود درست کردن")], "doc_id long, family_id string, text string")
    q = ask(spark, "The early bird catches the worm", "a stich in tme saves nine", "zzz qqq", "", "he told me that a stitch in time saves nine and went home", "کار زود درست می‌شود")
    got = {r.query_id: r for r in Engine(variants, glosses).surface(q).collect()}
    assert (got["q0"].decision, got["q0"].doc_id, got["q0"].reason) == ("ACCEPT", 0, "score-and-margin-passed")
    assert got["q1"].decision == "ACCEPT" and got["q1"].doc_id == 2
    assert (got["q2"].decision, got["q3"].reason) == ("ABSTAIN", "empty-query")
    assert got["q4"].doc_id == 2 and got["q4"].reason in ("score-and-margin-passed", "surface-evidence-agreement", "local-surface-evidence-agreement")
    auto = {r.query_id: r for r in Engine(variants, glosses).auto(q).collect()}
    assert auto["q0"].reason == "technical-out-of-domain-guard" and auto["q3"].reason == "empty-query" and auto["q5"].task in ("MEANING", "CLARIFY")
    free = {r.query_id: r for r in Engine(variants, glosses).auto(q, F.lit(None).cast("string")).collect()}
    assert (free["q0"].task, free["q0"].decision) == ("SURFACE", "ACCEPT") and free["q2"].task == "CLARIFY"
    assert {r.query_id for r in Engine(variants, glosses, Policy(candidates=3)).attest(q).where("status = 'ATTESTED'").collect()} == {"q0"}
    assert factory("groundphrase.operators.engine:surface_ranking").__name__ == "surface_ranking"
    for bad in ("nothing", ":x"):
        with pytest.raises(ValueError):
            factory(bad)
    with pytest.raises(ValueError):
        Policy(candidates=0)


def test_contained_both_ways(spark, variants):
    texts = spark.createDataFrame([("a", "He said: a stitch in time saves nine; the early bird catches the worm!"), ("b", "early bird catches worm"), ("c", None), ("d", "all that glitters all that glitters")], "query_id string, text string")
    one, two = ({tuple(r) for r in lexical.contained(texts, variants, dictionary=n).collect()} for n in (lexical.DICTIONARY, 0))
    assert one == two and {(k, f) for k, f, _ in one} == {("a", "f1"), ("a", "f2"), ("b", "f1"), ("d", "f4")}


def test_frozen_vectors(spark, tmp_path):
    from groundphrase.sources import vectors

    (tmp_path / "e").write_bytes(b"one")
    (tmp_path / "s").write_bytes(b"two")
    h = vectors.corpus_hash(spark, str(tmp_path / "e"), str(tmp_path / "s"))
    assert h == hashlib.sha256(b"one\0sources\0two").hexdigest()[:16]
    m = np.random.default_rng(1).normal(size=(1030, 3)).astype(np.float32)
    path, fams = str(tmp_path / "m.npy"), [f"f{i}" for i in range(1030)]
    vectors.write_matrix(path, m, "model", h, fams)
    got = vectors.read_frozen(spark, path, "model", h, fams).orderBy("row").collect()
    assert np.array_equal(np.array([r.v for r in got], np.float32), m) and got[7].family_id == "f7"
    for args in (("other", h, fams), ("model", "0", fams), ("model", h, fams[::-1])):
        with pytest.raises(ValueError):
            vectors.read_frozen(spark, path, *args)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="changed"):
        vectors.read_frozen(spark, path, "model", h, fams)
