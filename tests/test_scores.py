"""Scores of requests against a corpus: equal in one block or many, and without a shuffle of items or pairs."""

import random

import pandas as pd
import pytest

from groundphrase.operators import index, lexical
from groundphrase.plans import catalog

WORDS = "stitch time saves nine bird hand worth bush rolling stone gathers moss early worm catches never late learn still water runs deep".split()


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("sf"), random.Random(3)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    pd.DataFrame({"item_id": range(30), "text": [some(14) for _ in range(30)]}).to_parquet(at / "benchmark.parquet")
    pd.DataFrame({"conv_id": range(1500), "turn": [0] * 1500, "role": ["user"] * 1500, "text": [some(12) for _ in range(1500)]}).to_parquet(at / "conversations.parquet")
    return str(at)


def shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in stages}


@pytest.mark.parametrize("name", "tfidf_topk gloss_search attestation_suggestions meaning_decision gloss_rescored noisy_or_fusion rescore_chain family_dedupe_topk margin_top2 surface_decision fuzzy_rerank auto_dispatch".split())
def test_pairs_are_not_shuffled(spark, sf, name):
    before = shuffled(spark)
    assert catalog.QUERIES[name](spark, sf).count() > 0
    rows = sum(n for k, n in shuffled(spark).items() if k not in before)
    assert rows < 40_000, rows  # 1,624 requests meet 60 documents or 30: far more pairs, and items, than this


def test_blocks_agree(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choices(WORDS, k=n))
    docs = spark.createDataFrame([(i, some(5)) for i in range(25)], "doc_id long, text string")
    queries = spark.createDataFrame([(f"q{i}", some(6)) for i in range(20)] + [("none", "zzz qqq"), ("empty", ""), ("null", None), ("short", "time")], "query_id string, text string")
    plain = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    one = [lexical.evidence(queries, docs, 4), lexical.tfidf(queries, docs, 3), lexical.evidence(queries, docs)]
    one = [plain(x) for x in one]
    monkeypatch.setattr(lexical, "POSTINGS", 200)
    many = [lexical.evidence(queries, docs, 4), lexical.tfidf(queries, docs, 3), lexical.evidence(queries, docs)]
    assert lexical.Indexes(docs).postings("tcb")[1] > 400
    assert [plain(x) for x in many] == one
    assert one[1] == plain(index.ranked(index.tfidf(queries, index.trigram_index(docs)), k=3).select("query_id", "doc_id", "score", "rank"))
    pairs = spark.createDataFrame([(f"q{i}", i) for i in range(20)], "query_id string, doc_id long")
    of = {(r[0], r[1]): r for r in one[2]}
    got = plain(lexical.evidence(queries, docs, None, pairs))
    assert got == sorted(of[f"q{i}", i] for i in range(20) if (f"q{i}", i) in of)
