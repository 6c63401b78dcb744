"""The fuzzy plans run over all requests and all candidates, against the operators' pieces on a small corpus."""

import pandas as pd
import pytest

from groundphrase.functions import fuzzy as fz
from groundphrase.operators import index, lexical, local
from groundphrase.plans import fuzzy

TURN = "well i would say a stitch in time saves nine and then some more words"


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    heads = ["a stitch in time saves nine they", "a stitch in time saves ten men", "a bird in the hand is worth"]
    pd.DataFrame({"item_id": range(len(heads)), "text": [f"{h} again and again until the end" for h in heads]}).to_parquet(at / "benchmark.parquet")
    pd.DataFrame({"conv_id": [7, 7], "turn": [0, 1], "role": ["user", "assistant"], "text": [TURN, "no"]}).to_parquet(at / "conversations.parquet")
    return str(at)


def test_users_turns_and_all_candidates(spark, sf):
    requests, variants = fuzzy.b.requests(spark, sf), fuzzy.b.variants(spark, sf)
    ranked = {(r.query_id, r.doc_id): r["rank"] for r in index.ranked(lexical.fused(requests, variants)).collect()}
    got = {(r.query_id, r.doc_id): r for r in fuzzy.local_alignment(spark, sf).collect()}
    texts = {r.query_id: r.text for r in requests.collect()}
    docs = {r.doc_id: r.text.lower() for r in variants.collect()}
    has = {k for k, n in ranked.items() if n <= 10 and fz.windows(texts[k[0]] or "", docs[k[1]])}
    assert set(got) == has
    assert any(q == "u7-0" and n > 3 and (q, d) in got for (q, d), n in ranked.items())
    top = max((r for k, r in got.items() if k[0] == "u7-0"), key=lambda r: r.score)
    assert top.text == "a stitch in time saves nine" or "stitch in time saves" in top.text
    restored = {tuple(r) for r in fuzzy.restore_ordered(spark, sf).collect()}
    assert restored == {(r.query_id, r.family_id, round(r.ratio, 6), r.lcs, r.accepted) for r in local.ordered_restore(requests, variants).collect()}
